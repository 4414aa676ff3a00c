"""Multi-way equi-joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.plans.small import attach

JOIN_TYPES = ("left", "inner", "right", "full", "semi", "anti")


def _join_two(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    if how in ("semi", "anti"):
        return left.join(right, on, f"left_{how}")
    taken = set(left.columns)
    clash = [c for c in right.columns if c in taken and (c != on or how == "full")]
    twice = [c for c in clash if f"{c}_right" in taken or f"{c}_right" in right.columns]
    if twice:
        raise ValueError(f"columns {twice} clash more than once; rename them before the join")
    renamed = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    if how != "full":
        return left.join(renamed, on, how)
    # A full join keeps both keys; NULL marks the side that had no row.
    return left.join(renamed, F.col(on) == F.col(f"{on}_right"), "full")


def join_tables(dfs: Sequence[DataFrame], on: str, how: str = "left") -> DataFrame:
    """Fold ``dfs`` from the left over one key; NULL keys never match.

    Right columns whose name is taken get ``_right``.  The join algorithm is
    left to Catalyst and the adaptive planner.  A full join takes two tables:
    with more, a row of the third has no one key to be matched on.
    """
    if len(dfs) < 2:
        raise ValueError("a join needs at least two tables")
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; known: {JOIN_TYPES}")
    if how == "full" and len(dfs) > 2:
        raise ValueError("a full join takes two tables; coalesce the keys before joining a third")
    return reduce(lambda left, right: _join_two(left, right, on, how), dfs)


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    value_col: str,
    default: Column,
    output_col: str,
) -> DataFrame:
    """Value of the row's category, or ``default`` for an unknown one."""
    found = attach(df, table.withColumnRenamed(value_col, "__value"), keys, ["__value"])
    return found.withColumn(output_col, F.coalesce("__value", default)).drop("__value")


def members(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column ``table``."""
    ids = table.select(F.col(table.columns[0]).alias("__id"))
    return df.join(ids, F.col(column) == F.col("__id"), "left_semi")


def stack_predictions(models: dict[str, DataFrame], key: str, pred_col: str) -> DataFrame:
    """Per-model tables as one long table (key, model, prediction)."""
    rows = [
        t.select(key, F.lit(name).alias("model"), F.col(pred_col).cast("double").alias("prediction"))
        for name, t in models.items()
    ]
    if not rows:
        raise ValueError("no model predictions given")
    return reduce(DataFrame.unionByName, rows)
