import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldwise.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    shown = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def touched(row):
    return row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


def climb(hashes):
    """Root, and for each leaf its (sibling, sibling comes first) on every level."""
    ways = [[] for _ in hashes]
    nodes = [(h, [i]) for i, h in enumerate(hashes)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 2):
            run = nodes[k : k + 2]
            for side, (_, below) in enumerate(run):
                other = run[1 - side][0] if len(run) == 2 else ""
                for i in below:
                    ways[i].append((other, side == 1))
            above.append((sha(*[h for h, _ in run]), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], ways


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {n: climb([leaf(r) for r in trees[n]]) for n in names}
    root, tops = climb([built[n][0] for n in names])
    out = []
    for n, top in zip(names, tops):
        for row, way in zip(trees[n], built[n][1]):
            h = leaf((*row[:4], row[4] + 1)) if touched(row) else leaf(row)
            for other, first in way + top:
                h = sha(other, h) if first else sha(h, other)
            out.append((row[0], leaf(row), built[n][0], root, sha(*[o for o, _ in way + top]), h, h == root))
    return sorted(out, key=repr)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "x é", "y" * 3000]
    rows = [
        (None if i % 40 == 7 else i - i % 9 // 8, rng.choice(texts), rng.choice(langs), rng.choice([None, "a"]), rng.choice([None, 3, i]))
        for i in range(n)
    ]
    return rows + rows[:3]


def found(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'z' AS root", "1 AS leaf", "2 AS hash")
    one_more = F.col("n_chars") + 1
    tampered = merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), one_more, F.col("text")])
    checked = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)
    return sorted(map(tuple, merkle.manifest(df, checked=checked).collect()), key=repr)


@pytest.mark.parametrize("n, langs", [(1, ["a"]), (900, ["a", None, "", "é", "z"])])
def test_manifest_as_brute_force(spark, n, langs):
    rows = rows_of(n, langs)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [0, 4000])
def test_levels_joined_by_shuffle(spark, monkeypatch, limit):
    """No or only some stored levels are small enough for a broadcast."""
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", limit)
    rows = rows_of(150, [None, *"abcdefghijklmnop"])
    assert found(spark, rows) == brute(rows)


def test_row_limit_is_put_back_and_untampered_rows_verify(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    df = spark.createDataFrame(rows_of(20, ["a", "b"]), COLUMNS)
    got = merkle.manifest(df)
    assert got.where("verified").count() == got.count() == 23
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_empty_table_and_clash(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert merkle.manifest(empty).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(empty.withColumnRenamed("doc_id", "root"), key="root")
