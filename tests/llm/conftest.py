import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

TEXTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

# Words, contractions, digits, spaces of all kinds, letters outside ASCII, marks.
ALPHABET = "aab'srtvelmd 12!!  \n\t.,é ⅧΣ中́"


@pytest.fixture(scope="session")
def odd_texts() -> list:
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    long = " ".join(rng.choice(["the", "of", "erblea", "it's", "42", "--"]) for _ in range(60_000))
    return [None, "", " ", "\n\n", "a", "x" * 5000, "!" * 3000, long, long, *texts, texts[3], None]


@pytest.fixture(scope="session")
def odd_rows(odd_texts) -> list:
    """Repeated keys, a NULL key, NULL and repeated texts."""
    rows = [(i if i % 7 else 7, t) for i, t in enumerate(odd_texts)]
    return [*rows, (None, "keyless text"), (None, None)]


@pytest.fixture(scope="module")
def documents(spark):
    def make(rows, extra=None):
        df = spark.createDataFrame(rows, TEXTS)
        if extra:
            df = df.selectExpr("*", *extra)
        return df.repartition(3) if rows else df

    return make


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of the smallest scale."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
