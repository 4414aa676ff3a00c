"""Shared plumbing of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType

from foldwise.plans.small import VALUE_BYTES, broadcast_within
from foldwise.session import scratch_path

# Bytes of text that one step of a task works on; longer texts form steps of their own.
STEP_BYTES = 4 << 20
# The same where texts are only kept or left out: whole rows wait beside them.
FILTER_BYTES = 1 << 20

Columns = dict[str, object]


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def fields(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def steps(batch: pa.RecordBatch, column: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text or binary ``column`` holds about ``limit`` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    marks = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def pick(df: DataFrame, names: Sequence[str], result: StructType) -> DataFrame:
    """Only the named input columns; result columns must not repeat their names."""
    clash = {n.lower() for n in names} & {f.name.lower() for f in result.fields}
    if clash:
        raise ValueError(f"input columns {sorted(clash)} have the names of results; rename them")
    return df.select(*[f"`{n}`" for n in names])


def per_text(
    df: DataFrame,
    key: str,
    text: str,
    result: str,
    start: Callable[[], Callable[[list[str | None]], Columns]],
) -> DataFrame:
    """``key`` plus the ``result`` columns, computed from ``text`` without a shuffle.

    ``start`` runs once per task and gives the function that turns a list of
    texts into columns.  Every row is answered: NULL or repeated keys are rows
    like any other, and other columns of ``df`` are not looked at.
    """
    kinds = fields(result)
    narrow = pick(df, [key, text], kinds)
    schema = StructType([StructField(key, narrow.schema[0].dataType), *kinds.fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = start()
        for batch in batches:
            for part in steps(batch, 1):
                columns = answer(part.column(1).to_pylist())
                arrays = [part.column(0)] + [
                    pa.array(columns[f.name], target.field(f.name).type) for f in kinds.fields
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return narrow.mapInArrow(run, schema)


def filter_texts(
    df: DataFrame, text: str, start: Callable[[], Callable[[list[str | None]], np.ndarray]]
) -> DataFrame:
    """Rows of ``df``, all columns, whose text passes; nothing is shuffled.

    ``start`` runs once per task and gives the function from texts to a mask.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            for part in steps(batch, at, FILTER_BYTES):
                yield part.filter(pa.array(passes(part.column(at).to_pylist()), pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor cannot change rows that were written, and
    ids assigned before the write stay what they are.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if its measured size is small."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()["size"]
    return broadcast_within(df, size)


def _width(column: Column, kind: DataType) -> Column:
    """Upper estimate of a value's bytes, with those of nested values."""
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(VALUE_BYTES))
    more = F.lit(0)
    if isinstance(kind, (StringType, BinaryType)):
        more = F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        more = F.coalesce(VALUE_BYTES * F.size(column), F.lit(0))  # numbers only here
    return F.lit(VALUE_BYTES) + more


def is_empty(df: DataFrame) -> bool:
    """Whether a written table has no row, from its files' metadata."""
    return df.count() == 0


def require_text(df: DataFrame, text: str) -> None:
    kind = df.schema[text].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"column {text} is {kind}, not string")
