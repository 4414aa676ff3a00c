"""Narrow value ranges that are sure to hold given quantiles.

A mergeable sketch (``percentile_approx``) finds, in one scan without a
shuffle of rows, values a little below and above each quantile.  Exact work is
then needed inside these brackets only; callers check that the ranks they
wanted fell inside, and do the full work if not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.plans.ordering import with_row_index
from foldwise.session import cut_lineage

# The sketch is off by at most 1/ACCURACY of the rows; brackets reach twice as far.
ACCURACY = 10_000
REACH = 2.0 / ACCURACY

Bracket = tuple[float, float]


def quantile_brackets(
    df: DataFrame, columns: Mapping[str, Column], quantiles: Sequence[float]
) -> dict[str, list[Bracket]]:
    """Disjoint ascending brackets per named expression; none if it has no value."""
    ends = [min(max(q + side, 0.0), 1.0) for q in quantiles for side in (-REACH, REACH)]
    names = list(columns)
    sketched = df.agg(
        *[
            F.percentile_approx(columns[n].cast("double"), ends, ACCURACY).alias(f"q{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    found = {}
    for i, name in enumerate(names):
        values = sketched[f"q{i}"] or []
        merged: list[Bracket] = []
        for low, high in sorted(zip(values[::2], values[1::2])):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        found[name] = merged
    return found


# Half widths of a group's brackets, in shares of its rows: the least one that
# reaches past the sketch's error and two rows to either side is taken.
REACHES = (REACH, 1 / 2048, 1 / 256, 1 / 32, 1 / 4)


def group_brackets(
    df: DataFrame, columns: Mapping[str, Column], quantiles: Sequence[float], groups: Sequence[str]
) -> DataFrame:
    """One row per group: a column per named expression with its ``low`` and ``high`` ends.

    The sketches are combined before the shuffle; a group of few rows has a sketch of
    few values.  There is one pair of ends per quantile, and pairs may overlap; NULL where a group has no value of the expression.
    """
    spread = [min(max(q + sign * r, 0.0), 1.0) for r in REACHES for q in sorted(quantiles) for sign in (-1, 1)]
    names = list(columns)
    sketched = df.groupBy(*groups).agg(
        *[F.percentile_approx(columns[n].cast("double"), spread, ACCURACY).alias(f"__q{i}") for i, n in enumerate(names)],
        *[F.count(columns[n]).alias(f"__c{i}") for i, n in enumerate(names)],
    )

    def chosen(i: int) -> Column:
        ends, needed = f"__q{i}", F.lit(REACH) + 2.0 / F.col(f"__c{i}")
        width = 2 * len(quantiles)
        # Wider than any reach: every value is inside.
        found = F.transform(F.slice(ends, 1, width), lambda _, k: F.when(k % 2 == 0, float("-inf")).otherwise(float("inf")))
        for r in range(len(REACHES) - 1, -1, -1):
            found = F.when(needed <= REACHES[r] + REACH, F.slice(ends, 1 + r * width, width)).otherwise(found)
        return F.struct(
            F.filter(found, lambda _, k: k % 2 == 0).alias("low"), F.filter(found, lambda _, k: k % 2 == 1).alias("high")
        )

    return sketched.select(
        *groups, *[F.when(F.col(f"__c{i}") > 0, chosen(i)).alias(n) for i, n in enumerate(names)]
    )


def coarsen_between(value: Column, ends: Column) -> Column:
    """``coarsen`` for brackets in a column of ``group_brackets``.

    Values outside become the highest bracket end below them with gap 1, or the
    lowest start with gap -1.
    """
    inside = F.exists(F.arrays_zip(ends["low"], ends["high"]), lambda b: (value >= b["low"]) & (value <= b["high"]))
    below = F.array_max(F.filter(ends["high"], lambda h: h < value))
    return (
        F.when(inside, F.struct(value.alias("value"), F.lit(0).alias("gap")))
        .when(below.isNotNull(), F.struct(below.alias("value"), F.lit(1).alias("gap")))
        .otherwise(F.struct(F.array_min(ends["low"]).alias("value"), F.lit(-1).alias("gap")))
    )


def coarsen(value: Column, brackets: Sequence[Bracket]) -> Column:
    """struct(value, gap): values inside a bracket as they are with gap 0, all others
    as the nearest lower bracket end with gap 1 (below the first: its start, -1).

    Sorting by (value, gap) keeps the order of the values.
    """
    def place(v: Column | float, gap: int) -> Column:
        v = v if isinstance(v, Column) else F.lit(v)
        return F.struct(v.alias("value"), F.lit(gap).alias("gap"))

    result = place(brackets[0][0], -1)
    for low, high in brackets:
        result = (
            F.when(value > high, place(high, 1)).when(value >= low, place(value, 0)).otherwise(result)
        )
    return result


NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp")


def order_number(df: DataFrame, name: str) -> Column | None:
    """A double that sorts like the column, or None for types without one.

    Times without a zone are taken apart, since going through a zoned time
    could fold an hour onto itself.
    """
    kind, column = dict(df.dtypes)[name], F.col(name)
    if kind in NUMBER_TYPES:
        return column.cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "timestamp_ntz":
        minutes = (F.unix_date(column.cast("date")).cast("long") * 24 + F.hour(column)) * 60
        minutes = minutes + F.minute(column)
        return minutes * 60 + F.extract(F.lit("SECOND"), column).cast("double")
    return None


def rows_at_ranks(
    df: DataFrame, order_col: str, keys: Sequence[str], ranks: Sequence[int], total: int
) -> Column:
    """struct(c0, c1, ...): struct(order_col, keys) of the rows at 0-based ``ranks``.

    Rows are ordered by ``order_col``, then ``keys``; ``total`` is their number.
    Only rows inside the brackets of the wanted ranks are sorted; those before
    are counted.  Types without a sketch are sorted whole.
    """
    names = [order_col, *keys]
    rows = df.select(*names)
    value = order_number(df, order_col)
    brackets: list[Bracket] = []
    if value is not None and rows.where(value.isNull() | F.isnan(value)).limit(1).count() == 0:
        wanted = [r / max(total - 1, 1) for r in ranks]
        brackets = quantile_brackets(rows, {order_col: value}, wanted)[order_col]
    if brackets:
        near = F.lit(False)
        for low, high in brackets:
            near = near | value.between(low, high)
        before = rows.agg(
            *[F.count_if(value < low).alias(f"b{i}") for i, (low, _) in enumerate(brackets)],
            *[F.count_if(value <= high).alias(f"e{i}") for i, (_, high) in enumerate(brackets)],
        ).first()
        spans = [(before[f"b{i}"], before[f"e{i}"]) for i in range(len(brackets))]
        if all(any(b <= r < e for b, e in spans) for r in ranks):
            # Position among the near rows of each wanted rank.
            places = []
            for r in ranks:
                i = next(i for i, (b, e) in enumerate(spans) if b <= r < e)
                places.append(r - spans[i][0] + sum(e - b for b, e in spans[:i]))
            return _pick(rows.where(near), names, places)
    return _pick(rows, names, list(ranks))


def _pick(rows: DataFrame, names: Sequence[str], places: Sequence[int]) -> Column:
    indexed = with_row_index(rows, list(names), "__place")
    at = F.struct(*names)
    return cut_lineage(
        indexed.where(F.col("__place").isin(list(places))).agg(
            F.struct(
                *[
                    F.max(F.when(F.col("__place") == p, at)).alias(f"c{i}")
                    for i, p in enumerate(places)
                ]
            ).alias("cuts")
        )
    ).scalar()
