"""Table profiles: describe, missing values, histograms, group statistics (A1-A10)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.functions.hashing import shuffle_order
from foldwise.functions.numeric import present
from foldwise.operators.columns import numeric_columns, plot_columns
from foldwise.operators.quantiles import exact_quantiles
from foldwise.operators.sample import id_transitions
from foldwise.plans.ordering import with_row_index
from foldwise.plans.small import all_equal, attach, settle
from foldwise.session import cut_lineage

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
DEFAULT_BINS = 30
DEFAULT_TOP = 20


def _text(column: Column, kind: str) -> Column:
    return column.cast("string") if kind != "string" else column


# Texts of up to so many characters are counted as they are, longer ones by a digest.
_SHORT = 16


def top_values(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, column, uniq, top, freq) of non-numeric columns.

    ``top`` is the commonest value, the smallest one on ties.  Long texts are not
    shuffled: they are counted by their first characters and a 128-bit digest, and
    only the texts of winners that are long are looked up, each task sending its least.
    """
    kinds = dict(df.dtypes)

    def melted(*more: Column) -> DataFrame:
        entries = [
            F.struct(F.lit(c).alias("column"), _text(F.col(c), kinds[c]).alias("value")) for c in columns
        ]
        rows = df.select(*groups, F.inline(F.array(*entries))).where(F.col("value").isNotNull())
        start = F.left("value", F.lit(_SHORT))
        digest = F.when(F.char_length("value") > _SHORT, F.unhex(F.md5("value")))
        return rows.select(*groups, "column", start.alias("start"), digest.alias("digest"), *more)

    keys = [*groups, "column"]
    counts = melted().groupBy(*keys, "start", "digest").agg(F.count(F.lit(1)).alias("n"))
    # A text that is its own beginning is less than the longer ones.
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("start"), F.col("digest").isNotNull().alias("long")))
    if not any(kinds[c] == "string" for c in columns):
        return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("uniq"), best.alias("best")).select(
            *keys, "uniq", F.col("best.start").alias("top"), (-F.col("best.n")).alias("freq")
        )
    counts = cut_lineage(counts)
    summary = settle(
        counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("uniq"), best.alias("best")).select(
            *keys, "uniq", F.col("best.start").alias("top"), (-F.col("best.n")).alias("freq"), "best.long"
        )
    )
    open_ = summary.where("long")
    if open_.isEmpty():
        return summary.drop("long")
    tied = attach(counts, open_.withColumnRenamed("top", "least"), keys, ["least", "freq"])
    tied = settle(tied.where((F.col("n") == F.col("freq")) & (F.col("start") == F.col("least"))).select(*keys, "digest"))
    texts = melted("value").join(
        tied.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("digest").alias("__d")),
        all_equal([(k, f"__k{i}") for i, k in enumerate(keys)]) & (F.col("digest") == F.col("__d")), "left_semi",
    )
    least = cut_lineage(texts.groupBy(*keys).agg(F.min("value").alias("__least")))
    return attach(summary, least, keys, ["__least"]).select(
        *keys, "uniq", F.when(F.col("long"), F.col("__least")).otherwise(F.col("top")).alias("top"), "freq"
    )


def describe(
    df: DataFrame,
    groups: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    interpolation: str = "linear",
) -> DataFrame:
    """One row per (group and) column: counts, moments, quartiles, commonest value.

    Numeric columns have mean, sample std, min, exact quartiles and max; other
    columns have uniq, top and freq (A1; with ``groups`` A8).  NaN counts as missing.
    """
    names = [c for c in (columns or df.columns) if c not in groups]
    numeric = [c for c in numeric_columns(df) if c in names]
    other = [c for c in names if c not in numeric]
    if not names:
        raise ValueError("no columns to describe")

    aggs, entries = [], []
    nothing = F.lit(None).cast("double")
    for i, c in enumerate(names):
        x = present(df, c)
        aggs += [F.count(x).alias(f"c{i}"), F.count(F.lit(1)).alias(f"r{i}")]
        values = {"mean": nothing, "std": nothing, "min": nothing, "max": nothing}
        if c in numeric:
            x = x.cast("double")
            functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
            aggs += [f(x).alias(f"{k}{i}") for k, f in functions.items()]
            values = {k: F.col(f"{k}{i}") for k in functions}
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"c{i}").alias("count"),
                (F.col(f"r{i}") - F.col(f"c{i}")).alias("null_count"),
                *[v.alias(k) for k, v in values.items()],
            )
        )
    base = df.groupBy(*groups).agg(*aggs).select(*groups, F.inline(F.array(*entries)))
    keys = [*groups, "column"]
    if numeric:
        quartiles = exact_quantiles(df, numeric, QUARTILES, groups, interpolation)
        base = attach(base, quartiles, keys, list(QUARTILES))
    else:
        base = base.withColumns({q: nothing for q in QUARTILES})
    if other:
        base = attach(base, top_values(df, other, groups), keys, ["uniq", "top", "freq"])
    else:
        base = base.withColumns(
            {"uniq": F.lit(None).cast("long"), "top": F.lit(None).cast("string"),
             "freq": F.lit(None).cast("long")}
        )
    return base.select(
        *groups, "column", "count", "null_count", "uniq", "top", "freq", "mean", "std", "min",
        *QUARTILES, "max",
    )


def describe_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per statistic, one column per numeric column (A2).

    Quartiles are the nearest actual values.
    """
    names = [c for c in numeric_columns(df) if columns is None or c in columns]
    wide = describe(df, columns=names, interpolation="nearest")
    statistics = {
        "count": "count", "null_count": "null_count", "mean": "mean", "std": "std", "min": "min",
        "25%": "q25", "50%": "q50", "75%": "q75", "max": "max",
    }
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("statistic"), F.col(c).cast("double").alias("v"))
            for s, c in statistics.items()
        ]
    )
    rows = wide.select("column", F.inline(pairs))
    return rows.groupBy("statistic").agg(
        *[F.max(F.when(F.col("column") == c, F.col("v"))).alias(c) for c in names]
    )


def missing_table(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, column, missing_count, missing_pct); 0 percent for an empty table (A3)."""
    share = F.when(F.col("n_rows") > 0, F.col("missing_count") / F.col("n_rows") * 100)
    return table_profile(df, groups).select(
        *groups, "column", "missing_count", share.otherwise(0.0).alias("missing_pct")
    )


def table_profile(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row per column: table size, position, type and missing count (A4).

    Group by the source file to profile a directory of files in one pass.
    """
    kinds = [(c, t) for c, t in df.dtypes if c not in groups]
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(present(df, c)).alias(f"c{i}") for i, (c, _) in enumerate(kinds)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("position"),
            F.lit(t).alias("dtype"),
            (F.col("n_rows") - F.col(f"c{i}")).alias("missing_count"),
        )
        for i, (c, t) in enumerate(kinds)
    ]
    return counted.select(
        *groups, "n_rows", F.lit(len(kinds)).alias("n_columns"), F.inline(F.array(*entries))
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = DEFAULT_BINS) -> DataFrame:
    """(column, bin, bin_left, bin_right, count) with equal-width bins, empty ones too.

    The last bin is closed; a column with one single value gets a range of
    width 1 around it (A5).  The range is that of the finite values; infinite
    ones, where there are any, are counted apart in bins -1 and ``bins``.
    """
    infinite = F.abs("x") == float("inf")
    edges = []
    for i, c in enumerate(columns):
        x = present(df, c).cast("double")
        x = F.when(F.abs(x) != float("inf"), x)
        edges += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    bounds = df.agg(*edges).select(F.struct("*").alias("b")).scalar()
    entries = []
    for i, c in enumerate(columns):
        low, high = bounds.getField(f"lo{i}"), bounds.getField(f"hi{i}")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(low == high, low - 0.5).otherwise(low).alias("lo"),
                F.when(low == high, high + 0.5).otherwise(high).alias("hi"),
                present(df, c).cast("double").alias("x"),
            )
        )
    share = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rows = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("x").isNotNull())
        .select(
            "column",
            F.when(infinite, F.when(F.col("x") > 0, F.lit(bins)).otherwise(F.lit(-1)))
            .otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("long").alias("bin"),
        )
    )
    counts = rows.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    frame = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(bounds.getField(f"lo{i}") == bounds.getField(f"hi{i}"), bounds.getField(f"lo{i}") - 0.5)
            .otherwise(bounds.getField(f"lo{i}")).alias("lo"),
            F.when(bounds.getField(f"lo{i}") == bounds.getField(f"hi{i}"), bounds.getField(f"hi{i}") + 0.5)
            .otherwise(bounds.getField(f"hi{i}")).alias("hi"),
        )
        for i, c in enumerate(columns)
    ]
    grid = (
        df.sparkSession.range(1)
        .select(F.inline(F.array(*frame)))
        .where(F.col("lo").isNotNull())
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    apart = counts.where((F.col("bin") < 0) | (F.col("bin") >= bins)).select(
        "column", "bin",
        F.when(F.col("bin") < 0, float("-inf")).alias("bin_left"),
        F.when(F.col("bin") >= bins, float("inf")).alias("bin_right"), "count",
    )
    inside = grid.join(counts, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_left"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
    return inside.unionByName(apart)


def value_counts(
    df: DataFrame, column: str, top: int = DEFAULT_TOP, keep_null: bool = True
) -> DataFrame:
    """Commonest values, ties by value, at most ``top``."""
    rows = df.select(column) if keep_null else df.select(column).dropna()
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), F.col(column).asc_nulls_first()).limit(top)


def distributions(
    df: DataFrame, max_cols: int | None = None, bins: int = DEFAULT_BINS, top: int = DEFAULT_TOP
) -> DataFrame:
    """What a plot of each column shows, numeric columns first.

    (column, place, label, bin_left, bin_right, count): histogram bins of numeric
    columns, the ``top`` commonest values of the others, NULL being a value.
    """
    chosen = plot_columns(df, max_cols)
    numeric = [c for c in chosen if c in numeric_columns(df)]
    other = [c for c in chosen if c not in numeric]
    nothing = F.lit(None).cast("double")
    parts = []
    if numeric:
        parts.append(
            histograms(df, numeric, bins).select(
                "column", F.col("bin").alias("place"), F.lit(None).cast("string").alias("label"),
                "bin_left", "bin_right", "count",
            )
        )
    if other:
        kinds = dict(df.dtypes)
        entries = [
            F.struct(F.lit(c).alias("column"), _text(F.col(c), kinds[c]).alias("label")) for c in other
        ]
        counts = df.select(F.inline(F.array(*entries))).groupBy("column", "label").agg(
            F.count(F.lit(1)).alias("count")
        )
        by_count = W.partitionBy("column").orderBy(F.col("count").desc(), F.col("label").asc_nulls_first())
        ranked = counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= top)
        parts.append(
            ranked.select(
                "column", (F.col("place") - 1).cast("long").alias("place"), "label",
                nothing.alias("bin_left"), nothing.alias("bin_right"), "count",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def group_stats(df: DataFrame, group_by: str) -> DataFrame:
    """Mean and sample std of every other numeric column, and count, by key."""
    names = [c for c in numeric_columns(df) if c != group_by]
    aggs = [F.avg(c).alias(f"{c}_mean") for c in names]
    aggs += [F.stddev_samp(c).alias(f"{c}_std") for c in names]
    return df.groupBy(group_by).agg(*aggs, F.count(F.lit(1)).alias("count")).orderBy(group_by)


def group_describe(df: DataFrame, group_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Full describe of every column per group."""
    return describe(df, [group_by], columns)


def group_counts(df: DataFrame, group_by: str) -> DataFrame:
    """Rows per group, by group."""
    return df.groupBy(group_by).agg(F.count(F.lit(1)).alias("count")).orderBy(group_by)


def missing_matrix(
    df: DataFrame,
    keys: str | Sequence[str],
    buckets: int = 100,
    order: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(bucket, column, null_fraction): a missingness map of fixed size (A10).

    With ``order`` the buckets are equal runs of the ordered rows, otherwise
    they are spread by the hash of ``keys``.
    """
    names = list(columns or df.columns)
    # Flags only are moved, not the values.
    flags = [present(df, c).isNull().cast("double").alias(f"__f{i}") for i, c in enumerate(names)]
    if order:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        size = F.ceil(total / buckets)
        placed = with_row_index(df.select(*dict.fromkeys(order), *flags), order, "__row").withColumn(
            "bucket", F.floor(F.col("__row") / size).cast("int")
        )
    else:
        digits = F.substring(shuffle_order(keys, 0), 1, 8)
        bucket = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(buckets)).cast("int")
        placed = df.select(bucket.alias("bucket"), *flags)
    shares = placed.groupBy("bucket").agg(
        *[F.avg(f"__f{i}").alias(f"f{i}") for i in range(len(names))]
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("null_fraction"))
        for i, c in enumerate(names)
    ]
    return shares.select("bucket", F.inline(F.array(*entries)))


# Named profile steps; add your own function to extend them.
PROFILE_STEPS: dict[str, Callable[..., DataFrame]] = {
    "basic_stats": describe,
    "missing_values": missing_table,
    "missing_matrix": missing_matrix,
    "distributions": distributions,
    "group_stats": group_stats,
    "id_transitions": id_transitions,
}


def run_profile(
    df: DataFrame,
    steps: Mapping[str, Mapping[str, object]],
    extra: Mapping[str, Callable[..., DataFrame]] | None = None,
) -> dict[str, DataFrame]:
    """Run profile steps by name with their options; unknown names raise."""
    known = {**PROFILE_STEPS, **(extra or {})}
    unknown = [s for s in steps if s not in known]
    if unknown:
        raise ValueError(f"unknown profile steps {unknown}; known: {sorted(known)}")
    return {name: known[name](df, **options) for name, options in steps.items()}
