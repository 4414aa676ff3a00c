"""Exact quantiles of many columns, optionally per group, without big groups.

``percentile`` keeps a column's distinct values in one aggregation buffer.
Here equal values are counted first, the (group, column, value) counts are
range-partitioned, and running counts tell which value holds which rank.
A sketch, per group where there are groups, narrows this down beforehand: values
that cannot hold a wanted rank are counted as one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.numeric import present
from foldwise.plans.brackets import Bracket, coarsen, coarsen_between, group_brackets, quantile_brackets
from foldwise.plans.ordering import running_totals
from foldwise.plans.small import VALUE_BYTES, attach, broadcast_within, settle, total_bytes
from foldwise.session import cut_lineage

INTERPOLATIONS = ("linear", "nearest")
# Groups of up to so many rows are sorted as arrays.
SMALL_GROUP = 4096


def value_counts_long(
    df: DataFrame,
    columns: Sequence[str],
    groups: Sequence[str] = (),
    brackets: Mapping[str, Sequence[Bracket]] | Mapping[str, str] | None = None,
) -> DataFrame:
    """(groups, column, value, gap, n) with one row per distinct present value.

    With ``brackets``, as numbers or as the names of columns that hold them, the
    values between them are merged before the shuffle, marked by ``gap``.
    """

    def entry(c: str) -> Column:
        x = present(df, c).cast("double")
        if brackets and isinstance(brackets[c], str):
            at = coarsen_between(x, F.col(brackets[c]))
        elif brackets and brackets[c]:
            at = coarsen(x, brackets[c])
        else:
            at = F.struct(x.alias("value"), F.lit(0).alias("gap"))
        kept = F.when(x.isNotNull(), at)
        return F.struct(F.lit(c).alias("column"), kept.alias("at"))

    rows = df.select(*groups, F.inline(F.array(*[entry(c) for c in columns])))
    rows = rows.where(F.col("at").isNotNull()).select(*groups, "column", "at.value", "at.gap")
    return rows.groupBy(*groups, "column", "value", "gap").agg(F.count(F.lit(1)).alias("n"))


def _near_counts(df: DataFrame, columns: Sequence[str], brackets: Mapping[str, Sequence[Bracket]]) -> DataFrame:
    """``value_counts_long`` of the whole table with brackets as numbers, melting few of its rows.

    One aggregate counts what lies before and up to the end of each bracket: that gives
    the gaps, and brackets of a single value.  Only rows with a value inside a wider
    bracket are melted; they are written first, as counting them takes long code that
    would be run for every row of the table otherwise.
    """
    present_ = {c: present(df, c).cast("double") for c in columns if brackets[c]}
    kind = "column string, value double, gap int, n long"
    if not present_:
        return df.sparkSession.createDataFrame([], kind)
    aggs, near, open_ = [], F.lit(False), {}
    for i, (c, x) in enumerate(present_.items()):
        aggs.append(F.count(x).alias(f"n{i}"))
        for j, (low, high) in enumerate(brackets[c]):
            aggs += [F.count_if(x < low).alias(f"b{i}_{j}"), F.count_if(x <= high).alias(f"e{i}_{j}")]
        wide = [b for b in brackets[c] if b[0] < b[1]]
        if wide:
            open_[c] = wide
        for low, high in wide:
            near = near | x.between(low, high)
    found = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(present_):
        done = 0
        for j, (low, high) in enumerate(brackets[c]):
            before, upto = found[f"b{i}_{j}"], found[f"e{i}_{j}"]
            last = brackets[c][j - 1][1] if j else low
            rows.append((c, last, 1 if j else -1, before - done))
            if low == high:
                rows.append((c, low, 0, upto - before))
            done = upto
        rows.append((c, brackets[c][-1][1], 1, found[f"n{i}"] - done))
    counts = df.sparkSession.createDataFrame([r for r in rows if r[3]], kind)
    if not open_:
        return counts
    inside = cut_lineage(df.select(*open_).where(near))
    return counts.unionByName(value_counts_long(inside, list(open_), (), open_).where("gap = 0"))


def present_counts(
    df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """(groups, column, __total) from one aggregate over the columns themselves."""
    counted = df.groupBy(*groups).agg(
        *[F.count(present(df, c)).alias(f"__n_{i}") for i, c in enumerate(columns)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"__n_{i}").alias("__total"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select(*groups, F.inline(pairs))


def _place(position: Column, interpolation: str) -> list[Column]:
    """The 0-based ranks around a position; one, the closer one, for ``nearest``."""
    if interpolation == "nearest":
        return [F.floor(position + 0.5)]
    return [F.floor(position), F.ceil(position)]


def _small_groups(
    df: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float], groups: Sequence[str], interpolation: str
) -> DataFrame:
    """Exact quantiles of groups of ``SMALL_GROUP`` rows at most, from one shuffle by group."""
    listed = df.groupBy(*groups).agg(
        *[F.sort_array(F.collect_list(present(df, c).cast("double"))).alias(f"__v{i}") for i, c in enumerate(columns)]
    )

    def entry(i: int, c: str) -> Column:
        found = []
        for name, q in quantiles.items():
            position = (F.size(f"__v{i}").cast("long") - 1) * F.lit(float(q))
            ends = [F.get(f"__v{i}", r.cast("int")) for r in _place(position, interpolation)]
            value = ends[0]
            if len(ends) > 1:
                share = position - F.floor(position)
                value = F.when(ends[0] == ends[1], ends[0]).otherwise(ends[0] + (ends[1] - ends[0]) * share)
            found.append(value.alias(name))
        return F.struct(F.lit(c).alias("column"), F.size(f"__v{i}").alias("__count"), *found)

    rows = listed.select(*groups, F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    return rows.where("__count > 0").drop("__count")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: Mapping[str, float],
    groups: Sequence[str] = (),
    interpolation: str = "linear",
) -> DataFrame:
    """(groups, column, one column per quantile) over present values.

    ``linear`` interpolates between the two closest ranks, ``nearest`` takes the
    closer one (halves go up).  Groups of few rows need no sketch: each is sorted
    by itself, and only those of more than ``SMALL_GROUP`` rows take brackets.
    """
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"unknown interpolation {interpolation!r}; known: {INTERPOLATIONS}")
    if not groups:
        return _bracketed(df, columns, quantiles, groups, interpolation)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per SMALL_GROUP rows of the table at most.
    large = settle(sizes.where(F.col("__rows") > SMALL_GROUP))
    if large.isEmpty():
        return _small_groups(df, columns, quantiles, groups, interpolation)
    marked = attach(df.select(*groups, *columns), large, groups, ["__rows"])
    small = _small_groups(marked.where("__rows IS NULL"), columns, quantiles, groups, interpolation)
    rest = marked.where("__rows IS NOT NULL").drop("__rows")
    return small.unionByName(_bracketed(rest, columns, quantiles, groups, interpolation))


def _bracketed(
    df: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float], groups: Sequence[str], interpolation: str
) -> DataFrame:
    """Exact quantiles of groups of any size, or of the whole table, behind a sketch."""
    wanted = list(quantiles.values())
    values = {c: present(df, c) for c in columns}
    if groups:
        places = {c: f"__b{i}" for i, c in enumerate(columns)}
        ends = group_brackets(df, {places[c]: v for c, v in values.items()}, wanted, groups)
        located = attach(df.select(*groups, *columns), _settled(ends, places), groups, list(places.values()))
        counts = value_counts_long(located, columns, groups, places)
    else:
        counts = _near_counts(df, columns, quantile_brackets(df, values, wanted))
    found = cut_lineage(_read_ranks(df, counts, columns, quantiles, groups, interpolation))
    # One row per group and column.  A rank in a gap would mean the sketch missed it.
    if not found.where("__gap > 0").isEmpty():
        counts = value_counts_long(df, columns, groups)
        found = _read_ranks(df, counts, columns, quantiles, groups, interpolation)
    return found.drop("__gap")


def _settled(ends: DataFrame, places: Mapping[str, str]) -> DataFrame:
    """Brackets computed once, for broadcast if they are few."""
    fixed = cut_lineage(ends)
    numbers = sum((F.coalesce(2 * F.size(F.col(c)["low"]), F.lit(0)) for c in places.values()), F.lit(0))
    size = fixed.agg((total_bytes(fixed) + F.coalesce(F.sum(numbers * VALUE_BYTES), F.lit(0))).alias("size"))
    return broadcast_within(fixed, size.first()["size"])


def _read_ranks(
    df: DataFrame,
    counts: DataFrame,
    columns: Sequence[str],
    quantiles: Mapping[str, float],
    groups: Sequence[str],
    interpolation: str,
) -> DataFrame:
    keys = [*groups, "column"]
    placed = running_totals(counts, keys, ["value", "gap"], {"__before": F.col("n")})
    # Groups x columns rows, so that the join does not gather a column's values
    # by its name.
    totals = present_counts(df, columns, groups)
    totals = settle(totals) if groups else F.broadcast(totals)
    ranked = attach(placed, totals, keys, ["__total"])

    def held(rank: Column) -> Column:
        return (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("n"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(held(rank), F.col("value")))

    outputs, used = [], []
    for name, q in quantiles.items():
        position = (F.col("__total") - 1) * F.lit(float(q))
        if interpolation == "nearest":
            used.append(F.floor(position + 0.5))
            outputs.append(value_at(used[-1]).alias(name))
            continue
        used += [F.floor(position), F.ceil(position)]
        low, high = value_at(used[-2]), value_at(used[-1])
        share = F.max(position - F.floor(position))
        outputs.append(
            F.when(low == high, low).otherwise(low + (high - low) * share).alias(name)
        )
    in_gap = F.lit(False)
    for rank in used:
        in_gap = in_gap | (held(rank) & (F.col("gap") != 0))
    return ranked.groupBy(*keys).agg(*outputs, F.count_if(in_gap).alias("__gap"))
