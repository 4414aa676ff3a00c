"""Exact rank thresholds of a seeded shuffle, without sorting the table.

Splitting rows into parts of exact size in hash order needs only the hash at a
few ranks.  Counting rows per leading hash digits (map-side combined) tells
which bucket holds each rank, and only those buckets are sorted.  The table
itself is then classified by comparing each row's hash with the thresholds: no
shuffle of whole rows, whatever the size of a class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.functions.hashing import hash_bucket
from foldwise.plans.small import all_equal, settle


def cut_points(
    df: DataFrame,
    strata: Sequence[str],
    order: Column,
    ranks: Sequence[Callable[[Column], Column]],
) -> DataFrame:
    """One row per stratum: ``n`` rows, and ``cut_i`` = hash at 0-based ``ranks[i](n)``.

    A rank at or past the end of a stratum gives a NULL cut.
    """
    strata = list(strata)
    rows = df.select(*strata, order.alias("__h")).withColumn("__b", hash_bucket(F.col("__h")))
    counts = rows.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__c"))

    # At most 16**4 bucket rows per stratum.
    by_bucket = W.partitionBy(*strata).orderBy("__b")
    placed = counts.select(
        *[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)],
        F.col("__b").alias("__at"),
        "__c",
        F.coalesce(
            F.sum("__c").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__c").over(W.partitionBy(*strata)).alias("__n"),
    )
    wanted = F.array(*[r(F.col("__n")).cast("long") for r in ranks])
    holds_rank = F.exists(
        wanted, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c"))
    )
    # The first bucket stays too, so that every stratum reports its size.
    located = placed.where(holds_rank | (F.col("__before") == 0)).drop("__c")
    # Without strata there are at most len(ranks) + 1 such buckets.
    located = settle(located) if strata else F.broadcast(located)
    pairs = [(s, f"__s{i}") for i, s in enumerate(strata)] + [("__b", "__at")]
    ranked = rows.join(located, all_equal(pairs)).withColumn(
        "__rank",
        F.col("__before")
        - 1
        + F.row_number().over(W.partitionBy(*strata, "__b").orderBy("__h")),
    )
    return ranked.groupBy(*strata).agg(
        F.max("__n").alias("n"),
        *[
            F.max(F.when(F.col("__rank") == r(F.col("__n")), F.col("__h"))).alias(f"cut_{i}")
            for i, r in enumerate(ranks)
        ],
    )


def even_cut_ranks(parts: int) -> list[Callable[[Column], Column]]:
    """Ranks that cut n rows into ``parts`` runs whose sizes differ by at most 1.

    The first ``n mod parts`` runs are the longer ones.
    """

    def rank(j: int) -> Callable[[Column], Column]:
        return lambda n: F.floor(n / parts) * j + F.least(F.lit(j), n % parts)

    return [rank(j) for j in range(1, parts)]


def cuts_passed(order: Column, cuts: Sequence[Column]) -> Column:
    """How many cuts lie at or before a row: the number of its run."""
    passed = F.lit(0)
    for cut in cuts:
        passed = passed + F.coalesce((order >= cut).cast("int"), F.lit(0))
    return passed
