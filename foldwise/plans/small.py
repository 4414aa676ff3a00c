"""Joins against fitted tables: broadcast behind a checked size, NULL-safe keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.session import cut_lineage

# Largest fitted table that is broadcast; bigger ones take a shuffled join.
BROADCAST_BYTES = 64 * 1024 * 1024
# A fixed-width value, with what a hash table adds to it.
VALUE_BYTES = 24


def total_bytes(df: DataFrame) -> Column:
    """Aggregate: upper estimate of the size of all rows, long texts included."""
    width = F.lit(VALUE_BYTES * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return F.coalesce(F.sum(width), F.lit(0))


def broadcast_within(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table of known size for broadcast if it is small."""
    return F.broadcast(df) if size <= limit else df


def settle(df: DataFrame) -> DataFrame:
    """Compute a fitted table once; mark it for broadcast only if it is small.

    The table is written to the checkpoint folder, so using it several times
    does not repeat the fit, and its true size decides the join.
    """
    return broadcast_within(*measured(df))


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """A table computed once and written to the checkpoint folder, and its size in bytes."""
    fixed = cut_lineage(df)
    return fixed, fixed.agg(total_bytes(fixed).alias("size")).first()["size"]


def require_unique(table: DataFrame, keys: Sequence[str]) -> None:
    """Raise if rows share their keys: a join back would multiply them."""
    repeated = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"keys {list(keys)} are not unique")


def all_equal(pairs: Sequence[tuple[str, str]]) -> Column:
    """NULL-safe equality of several column pairs."""
    condition = F.lit(True)
    for left, right in pairs:
        condition = condition & F.col(left).eqNullSafe(F.col(right))
    return condition


def attach(
    df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Left-join ``values`` of ``table`` to ``df``; NULL is a key like any other."""
    renamed = {k: f"__key_{i}" for i, k in enumerate(keys)}
    right = table.select(*[F.col(k).alias(renamed[k]) for k in keys], *values)
    joined = df.join(right, all_equal(list(renamed.items())), "left")
    return joined.drop(*renamed.values())
