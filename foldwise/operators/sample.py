"""Exact stratified samples, recency weights and duplicate-key histories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foldwise.functions.hashing import key_columns, shuffle_order
from foldwise.plans.brackets import rows_at_ranks
from foldwise.plans.cuts import cut_points
from foldwise.plans.ordering import with_row_index
from foldwise.plans.small import BROADCAST_BYTES, attach, broadcast_within, measured, require_unique, settle


def stratified_subsample(
    df: DataFrame, fraction: float, stratify_col: str, keys: str | Sequence[str], seed: int = 42
) -> DataFrame:
    """Exactly ``max(1, floor(n * fraction))`` rows of every class."""
    if fraction >= 1.0:
        return df
    order = shuffle_order(keys, seed)
    size = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))
    cuts = settle(cut_points(df, [stratify_col], order, [size]))
    kept = attach(df, cuts, [stratify_col], ["cut_0"])
    return kept.where(F.col("cut_0").isNull() | (order < F.col("cut_0"))).drop("cut_0")


# exp(-746) is less than half of the smallest positive double.
_VANISHED = 746.0


def vanishing_age(decay: float) -> int | None:
    """An age from which ``decay ** age`` is 0.0; None if there is none."""
    if decay == 0.0:
        return 1
    return math.ceil(_VANISHED / -math.log(decay)) if 0.0 < decay < 1.0 else None


def exp_weight(
    df: DataFrame,
    time_col: str,
    keys: str | Sequence[str],
    decay: float = 0.95,
    weight_col: str = "__weight__",
) -> DataFrame:
    """``decay ** (rows newer than this one)``; the newest row weighs 1.0.

    Rows so old that their weight is 0.0 in double precision get it in place: a cut
    at the rank of that age (a sketch, then the few rows near it) tells them.  Only
    times and keys of the newer rows are ordered, and their weights joined back, by
    broadcast where their measured size allows.  ``keys`` must be unique; of rows that
    are ordered, and of all rows where every weight is one, this is checked
    (``ValueError``).  NULL times are the oldest.
    """
    names = key_columns(keys)
    at = list(dict.fromkeys([time_col, *names]))
    if decay == 1.0:
        require_unique(df.select(*names), names)
        return df.withColumn(weight_col, F.lit(1.0))
    narrow, age = df.select(*at), vanishing_age(decay)
    newer = None
    if age is not None:
        total = df.count()
        if age < total:
            cut = rows_at_ranks(narrow, time_col, [c for c in at if c != time_col], [total - age], total)
            newer = F.struct(*at) >= cut.getField("c0")
    newest_first = [F.col(c).desc_nulls_last() for c in at]
    aged = with_row_index(narrow if newer is None else narrow.where(newer), newest_first, "__age")
    require_unique(aged, names)
    weights, size = measured(aged.select(*at, F.pow(F.lit(float(decay)), F.col("__age")).alias("__w")))
    weight = F.coalesce("__w", F.lit(0.0))
    if newer is None or size <= BROADCAST_BYTES:
        weights = broadcast_within(weights, size)
        return attach(df, weights, at, ["__w"]).withColumn(weight_col, weight).drop("__w")
    # Too many for a broadcast: only rows that have a weight are shuffled.
    heavy = attach(df.where(newer), weights, at, ["__w"]).withColumn(weight_col, weight).drop("__w")
    light = df.where(~newer).withColumn(weight_col, F.lit(0.0))
    return heavy.unionByName(light)


def duplicated(df: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id occurs more than once.

    Counting first (map-side combined) keeps a very common id off one task; the
    semi join's big side is split by the adaptive skew join.
    """
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    repeated = repeated.select(F.col(id_col).alias("__id"))
    return df.join(repeated, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")


def id_transitions(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """(id, order) of every row with a repeated id, in ``order``."""
    rows = duplicated(df.select(*dict.fromkeys([id_col, *order])), id_col)
    return with_row_index(rows, order, "order").select(id_col, "order")
