"""Global row positions and running totals without an unpartitioned window.

``lay_out`` range-partitions the rows by a total order, sorts every partition
and materialises the result, so that partition number and position become plain
data: later passes read them back, and a lost executor cannot change them.
Everything that needs "the rows before this one" is then a small table of
per-partition aggregates plus a window inside each partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.session import cut_lineage

PART = "__part"
POS = "__pos"

# monotonically_increasing_id keeps the partition in the bits above this one.
_POSITION_BITS = 33


def ascending(columns: Sequence[str | Column]) -> list[Column]:
    """Ascending sort columns, missing values first."""
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in columns]


def lay_out(
    df: DataFrame, order: Sequence[str | Column], num_partitions: int | None = None
) -> DataFrame:
    """``df`` in range partitions of ``order`` with columns ``__part``, ``__pos``.

    ``order`` should be total (end it with a key); then even one value that
    holds a large share of the rows is split over many partitions.
    """
    cols = ascending(order)
    ranged = (
        df.repartitionByRange(num_partitions, *cols)
        if num_partitions
        else df.repartitionByRange(*cols)
    )
    tag = F.monotonically_increasing_id()
    placed = ranged.sortWithinPartitions(*cols).withColumn("__tag", tag)
    placed = placed.select(
        "*",
        F.shiftright("__tag", _POSITION_BITS).cast("int").alias(PART),
        F.col("__tag").bitwiseAND((1 << _POSITION_BITS) - 1).alias(POS),
    ).drop("__tag")
    return cut_lineage(placed)


def with_row_index(
    df: DataFrame,
    order: Sequence[str | Column],
    output_col: str = "row_index",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based global position of every row in ``order``."""
    placed = lay_out(df, order, num_partitions)
    # One row per partition: bounded by the partition count, so the window and
    # the broadcast below stay small whatever the table holds.
    starts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("__n")).select(
        PART,
        F.coalesce(
            F.sum("__n").over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__start"),
    )
    return (
        placed.join(F.broadcast(starts), PART)
        .withColumn(output_col, F.col("__start") + F.col(POS))
        .drop(PART, POS, "__start")
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """Exclusive running totals per key in ``order``, safe for huge keys.

    ``totals`` maps output names to the expressions to add up; each row gets the
    total over the *earlier* rows of its key (0 for the first).  A key that
    spans several range partitions gets one carry row per later partition,
    holding what came before it, so no window ever sees more than one
    partition of one key.
    """
    keys = list(keys)
    staged = df.select("*", *[e.alias(f"__v_{name}") for name, e in totals.items()])
    placed = lay_out(staged, [*keys, *order], num_partitions)
    value_cols = [f"__v_{name}" for name in totals]

    per_part = placed.groupBy(*keys, PART).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in value_cols]
    )
    # At most one row per (key, partition); keys inside one partition drop out.
    # Without keys this is one row per partition.
    before = W.partitionBy(*keys).orderBy(PART)
    carries = (
        per_part.withColumn("__first", F.row_number().over(before))
        .select(
            *keys,
            PART,
            "__first",
            *[
                F.sum(v).over(before.rowsBetween(W.unboundedPreceding, -1)).alias(v)
                for v in value_cols
            ],
        )
        .where(F.col("__first") > 1)
        .withColumn(POS, F.lit(-1).cast("long"))
        .drop("__first")
    )
    inside = (
        W.partitionBy(*keys, PART).orderBy(POS).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        placed.unionByName(carries, allowMissingColumns=True)
        .select(
            "*",
            *[
                F.coalesce(F.sum(f"__v_{name}").over(inside), F.lit(0)).alias(name)
                for name in totals
            ],
        )
        .where(F.col(POS) >= 0)
        .drop(PART, POS, *value_cols)
    )


def running_totals_of(
    df: DataFrame,
    keys: Mapping[str, Sequence[str]],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """``running_totals`` for several keys from one layout by ``order``.

    ``keys`` maps a suffix to key columns (none: all rows); outputs are named
    ``<total>_<suffix>``.  The rows are range-partitioned, sorted and written once, by
    ``order`` alone.  What a key has in earlier ranges is an aggregate per (key,
    range) with a prefix over the ranges, and comes back as carry rows; one exchange
    brings all carries to their ranges, where each further key costs a window.
    """
    staged = df.select("*", *[e.alias(f"__v_{name}") for name, e in totals.items()])
    placed = lay_out(staged, order, num_partitions)
    values = [f"__v_{name}" for name in totals]
    parts = [placed.withColumn("__for", F.lit(None).cast("string"))]
    for suffix, key in keys.items():
        per_part = placed.groupBy(*key, PART).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
        # A row per range that holds the key; the window of no key has one per range.
        before = W.partitionBy(*key).orderBy(PART)
        earlier = before.rowsBetween(W.unboundedPreceding, -1)
        carries = per_part.select(
            *key, PART, F.row_number().over(before).alias("__first"), *[F.sum(v).over(earlier).alias(v) for v in values]
        )
        carries = carries.where("__first > 1").drop("__first")
        parts.append(carries.withColumns({POS: F.lit(-1).cast("long"), "__for": F.lit(suffix)}))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(PART)
    found = []
    for suffix, key in keys.items():
        inside = W.partitionBy(PART, *key).orderBy(POS).rowsBetween(W.unboundedPreceding, -1)
        own = F.col("__for").isNull() | (F.col("__for") == suffix)
        found += [
            F.coalesce(F.sum(F.when(own, F.col(f"__v_{name}"))).over(inside), F.lit(0)).alias(f"{name}_{suffix}")
            for name in totals
        ]
    return together.select("*", *found).where(F.col(POS) >= 0).drop(PART, POS, "__for", *values)
