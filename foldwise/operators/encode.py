"""Leak-free target encodings.

A category's code for a row must not use that row's own fold.  Statistics are
aggregated once per (category, fold); what a fold may see is the merge of the
category's other folds, at most ``n_splits`` entries.  Codes go back to the
rows by a join on (category, fold), NULL being a category like any other.
Rows without a target take no part in fitting but are encoded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.functions.hashing import hash_fold, key_columns
from foldwise.functions.numeric import present
from foldwise.operators.columns import composite_name, encoded_name, require_columns
from foldwise.operators.joins import lookup
from foldwise.operators.split import kfold_expression
from foldwise.plans.ordering import running_totals, running_totals_of
from foldwise.plans.small import attach, broadcast_within, require_unique, total_bytes
from foldwise.session import cut_lineage

ColumnSpec = str | Sequence[str]
TARGET_TYPES = ("binary", "continuous")
BAYES_SUFFIX = "_te"
FOLD = "__fold"


@dataclass(frozen=True)
class Encoder:
    """Fitted encoder of one (composite) column: a table and a one-row prior."""

    name: str
    keys: list[str]
    table: DataFrame
    prior: DataFrame
    value_col: str


# --- statistics ---------------------------------------------------------------


class Moments:
    """Count, mean and centred square sum of the target for several groupings.

    One scan with grouping sets, combined on the map side; the result is kept
    in the checkpoint folder, and its true sizes decide which parts are small
    enough to broadcast.  A grouping that is only there together with the fold
    is merged from its folds.
    """

    def __init__(self, df: DataFrame, y: Column, groupings: Sequence[Sequence[str]]):
        self._sets = list(dict.fromkeys(tuple(dict.fromkeys(g)) for g in groupings))
        self._columns = list(dict.fromkeys(c for g in self._sets for c in g))
        narrow = df.select(*self._columns, y.alias("__y"))
        n = F.count("__y")
        grouped = narrow.groupingSets([[F.col(c) for c in g] for g in self._sets], *self._columns)
        self._table = cut_lineage(
            grouped.agg(
                F.grouping_id().cast("long").alias("__set"),
                n.alias("n"),
                F.avg("__y").alias("mean"),
                F.coalesce(F.var_pop("__y") * n, F.lit(0.0)).alias("m2"),
            )
        )
        sizes = self._table.groupBy("__set").agg(total_bytes(self._table).alias("size"))
        self._sizes = {r["__set"]: r["size"] for r in sizes.collect()}

    def _set(self, grouping: Sequence[str]) -> int:
        bits = ["0" if c in grouping else "1" for c in self._columns]
        return int("".join(bits) or "0", 2)

    def _stored(self, grouping: Sequence[str]) -> list[str]:
        known = tuple(grouping) in self._sets
        return list(grouping) if known else [*grouping, FOLD]

    def by(self, grouping: Sequence[str]) -> DataFrame:
        """(grouping columns, n, mean, m2) of one grouping."""
        stored = self._stored(grouping)
        rows = self._table.where(F.col("__set") == self._set(stored)).select(
            *stored, "n", "mean", "m2"
        )
        if stored == list(grouping):
            return rows
        # One row per fold and group: merged around the mean of the group.
        group = W.partitionBy(*grouping)
        total = F.nullif(F.sum("n").over(group), F.lit(0))
        centred = rows.withColumn("__mean", F.sum(F.col("n") * F.col("mean")).over(group) / total)
        apart = F.col("n") * F.pow(F.col("mean") - F.col("__mean"), F.lit(2.0))
        return centred.groupBy(*grouping).agg(
            F.sum("n").alias("n"),
            F.max("__mean").alias("mean"),
            F.sum(F.col("m2") + F.coalesce(apart, F.lit(0.0))).alias("m2"),
        )

    def sized(self, table: DataFrame, grouping: Sequence[str]) -> DataFrame:
        """``table``, one row per group, marked for broadcast if it is small."""
        return broadcast_within(table, self._sizes.get(self._set(self._stored(grouping)), 0))


def _target(df: DataFrame, target_col: str) -> Column:
    return present(df, target_col).cast("double")


# Up to this many folds a window adds them up; with more, running totals do,
# which no single task holds.  Both give the same sums.
_WINDOW_FOLDS = 1000


def _other_folds(stats: DataFrame, keys: Sequence[str], squares: bool, many: bool) -> DataFrame:
    """(keys, fold, n, mean[, m2]) of all folds except the row's own.

    What comes before and after the own fold is added up, so nothing is
    subtracted between folds and nothing cancels.  Sums are taken around the
    group's mean c: m2 of the others is the sum of m2 + n (mean - c)^2 less
    s^2 / n, with s the sum of n (mean - c).  Linear in the number of folds.
    """
    weight = F.coalesce(F.col("n"), F.lit(0))
    if squares:
        whole = stats.groupBy(*keys).agg(
            (F.sum(weight * F.col("mean")) / F.nullif(F.sum(weight), F.lit(0))).alias("__c")
        )
        stats = attach(stats, whole, keys, ["__c"]) if keys else stats.withColumn("__c", whole.scalar())
    else:
        stats = stats.withColumn("__c", F.lit(0.0))
    apart = F.coalesce(F.col("mean") - F.col("__c"), F.lit(0.0))
    parts = {"n": weight, "s": weight * apart}
    if squares:
        parts["q"] = F.coalesce("m2", F.lit(0.0)) + weight * apart * apart
    rows = stats.select(*keys, FOLD, "__c", *[v.alias(f"__{k}") for k, v in parts.items()])
    if many:
        for side, order in (("b", F.col(FOLD).asc_nulls_first()), ("a", F.col(FOLD).desc_nulls_last())):
            rows = running_totals(rows, keys, [order], {f"__{k}{side}": F.col(f"__{k}") for k in parts})
    else:
        by_fold = W.partitionBy(*keys).orderBy(FOLD)
        for side, span in (
            ("b", by_fold.rowsBetween(W.unboundedPreceding, -1)),
            ("a", by_fold.rowsBetween(1, W.unboundedFollowing)),
        ):
            rows = rows.withColumns(
                {f"__{k}{side}": F.coalesce(F.sum(f"__{k}").over(span), F.lit(0)) for k in parts}
            )
    n, s = F.col("__nb") + F.col("__na"), F.col("__sb") + F.col("__sa")
    mean = F.col("__c") + s / F.nullif(n, F.lit(0))
    columns = [n.alias("n"), mean.alias("mean")]
    if squares:
        square = F.col("__qb") + F.col("__qa")
        m2 = F.greatest(square - s * s / F.nullif(n, F.lit(0)), F.lit(0.0))
        columns.append(F.coalesce(m2, F.lit(0.0)).alias("m2"))
    return rows.select(*keys, FOLD, *columns)


def smoothed_mean(n: Column, mean: Column, prior: Column, smoothing: float) -> Column:
    """(n * mean + s * prior) / (n + s); the prior where that is 0/0."""
    weight = n + F.lit(float(smoothing))
    pulled = F.coalesce(n * mean, F.lit(0.0)) + F.lit(float(smoothing)) * prior
    return F.when(n > 0, pulled / F.nullif(weight, F.lit(0.0))).otherwise(prior)


def beta_binomial(n: Column, mean: Column, prior: Column, weight: float) -> Column:
    """Posterior of a rate as struct(mean, var, alpha, beta)."""
    w = F.lit(float(weight))
    successes = F.coalesce(n * mean, F.lit(0.0))
    alpha = prior * w + successes
    beta = (F.lit(1.0) - prior) * w + (n - successes)
    total = F.nullif(alpha + beta, F.lit(0.0))
    return F.struct(
        F.coalesce(alpha / total, prior).alias("mean"),
        F.coalesce(alpha * beta / (total * total * (total + 1.0)), F.lit(0.0)).alias("var"),
        alpha.alias("alpha"),
        beta.alias("beta"),
    )


def normal_gamma(n: Column, mean: Column, m2: Column, prior: Column, weight: float) -> Column:
    """Posterior of a mean as struct(mean, var, alpha, beta)."""
    w = F.lit(float(weight))
    kappa = F.nullif(w + n, F.lit(0.0))
    x = F.coalesce(mean, prior)
    alpha = F.lit(1.0) + n / 2.0
    pull = F.coalesce(w * n * F.pow(x - prior, F.lit(2.0)) / (kappa * 2.0), F.lit(0.0))
    beta = F.lit(1.0) + m2 * 0.5 + pull
    return F.struct(
        F.coalesce((w * prior + n * x) / kappa, prior).alias("mean"),
        F.coalesce(beta / (alpha * kappa), F.lit(0.0)).alias("var"),
        alpha.alias("alpha"),
        beta.alias("beta"),
    )


def posterior(
    target_type: str, n: Column, mean: Column, m2: Column, prior: Column, weight: float
) -> Column:
    if target_type not in TARGET_TYPES:
        raise ValueError(f"unknown target_type {target_type!r}; known: {TARGET_TYPES}")
    n = n.cast("double")
    if target_type == "binary":
        return beta_binomial(n, mean, prior, weight)
    return normal_gamma(n, mean, m2, prior, weight)


# --- folds --------------------------------------------------------------------


def _fold(
    df: DataFrame,
    keys: str | Sequence[str] | None,
    n_splits: int,
    seed: int,
    fold_col: str | None,
    exact: bool,
) -> Column:
    if fold_col is not None:
        return F.col(fold_col).cast("int")
    if keys is None:
        raise ValueError("give key columns for the folds, or a fold column")
    if not exact:
        return hash_fold(keys, n_splits, seed)
    return kfold_expression(df, keys, n_splits, seed)


def _specs(df: DataFrame, columns: Sequence[ColumnSpec]) -> list[tuple[str, list[str]]]:
    specs = [composite_name(c) for c in columns]
    for _, keys in specs:
        require_columns(df, keys)
    return specs


# --- smoothed target encoding ---------------------------------------------------


def fit_target_encoder(
    df: DataFrame, columns: Sequence[ColumnSpec], target_col: str, smoothing: float = 1.0
) -> dict[str, Encoder]:
    """Smoothed category means over all rows (E4: A12, A13)."""
    specs = _specs(df, columns)
    moments = Moments(df, _target(df, target_col), [[], *[cat for _, cat in specs]])
    return _smoothed_encoders(moments, specs, smoothing)


def _smoothed_encoders(
    moments: Moments, specs: Sequence[tuple[str, list[str]]], smoothing: float
) -> dict[str, Encoder]:
    prior = moments.by([]).select(F.col("mean").alias("encoded"))
    code = smoothed_mean(F.col("n"), F.col("mean"), prior.scalar(), smoothing)
    found = {}
    for name, cat in specs:
        table = moments.by(cat).select(*cat, F.col("n").alias("n_samples"), code.alias("encoded"))
        found[name] = Encoder(name, cat, moments.sized(table, cat), prior, "encoded")
    return found


def _attach_codes(
    df: DataFrame, codes: DataFrame, cat: Sequence[str], outputs: dict[str, str]
) -> DataFrame:
    """Codes by (category, fold); ``outputs`` maps new columns to code columns."""
    joined = attach(df, codes, [*cat, FOLD], list(outputs.values()))
    return joined.withColumns({out: F.col(c) for out, c in outputs.items()}).drop(
        *outputs.values()
    )


def _ensure_distinct_outputs(df: DataFrame, outputs: Sequence[str], used: Sequence[str]) -> None:
    if len(set(outputs)) < len(outputs):
        raise ValueError(f"encoded columns clash: {outputs}")
    again = [c for c in outputs if c in df.columns and used.count(c) > 1]
    if again:
        raise ValueError(f"columns {again} are replaced but used again; give a suffix or prefix")


def target_encode(
    df: DataFrame,
    columns: Sequence[ColumnSpec],
    target_col: str,
    keys: str | Sequence[str] | None = None,
    n_splits: int = 5,
    seed: int = 42,
    smoothing: float = 1.0,
    suffix: str = "",
    prefix: str = "",
    fold_col: str | None = None,
    exact_folds: bool = True,
) -> tuple[DataFrame, dict[str, Encoder]]:
    """Out-of-fold smoothed means, and the encoder fitted on all rows.

    Folds come from ``fold_col`` or from the seeded shuffle of ``keys``.  Without
    suffix and prefix the category column is replaced.
    """
    specs = _specs(df, columns)
    names = [encoded_name(name, prefix, suffix) for name, _ in specs]
    _ensure_distinct_outputs(df, names, [c for _, cat in specs for c in cat])
    fold = _fold(df, keys, n_splits, seed, fold_col, exact_folds)
    result = df.withColumn(FOLD, fold)
    moments = _fold_moments(result, _target(df, target_col), specs)
    many = moments.by([FOLD]).count() > _WINDOW_FOLDS
    by_fold = _other_folds(moments.by([FOLD]), [], False, many).select(FOLD, F.col("mean").alias("__prior"))
    by_fold = moments.sized(by_fold, [FOLD])
    for (name, cat), out in zip(specs, names):
        seen = attach(_other_folds(moments.by([*cat, FOLD]), cat, False, many), by_fold, [FOLD], ["__prior"])
        code = smoothed_mean(F.col("n"), F.col("mean"), F.col("__prior"), smoothing)
        codes = seen.select(*cat, FOLD, code.alias("__code"))
        codes = moments.sized(codes, [*cat, FOLD])
        result = _attach_codes(result, codes, cat, {out: "__code"})
    return result.drop(FOLD), _smoothed_encoders(moments, specs, smoothing)


def _fold_moments(
    df: DataFrame, y: Column, specs: Sequence[tuple[str, list[str]]]
) -> Moments:
    """Moments by fold, and by category and fold: all that fit and out-of-fold need."""
    cats = [cat for _, cat in specs]
    return Moments(df, y, [[], [FOLD], *[[*cat, FOLD] for cat in cats]])


def transform_target_encode(
    df: DataFrame,
    encoders: dict[str, Encoder],
    columns: Sequence[ColumnSpec],
    suffix: str = "",
    prefix: str = "",
) -> DataFrame:
    """Codes from a fitted encoder; unknown categories get the overall mean (E5)."""
    for name, keys in _specs(df, columns):
        e = encoders[name]
        out = encoded_name(name, prefix, suffix)
        df = lookup(df, e.table, e.keys, e.value_col, e.prior.select(e.value_col).scalar(), out)
    return df


# --- Bayesian target encoding -----------------------------------------------------


def fit_bayesian_encoder(
    df: DataFrame,
    columns: Sequence[ColumnSpec],
    target_col: str,
    target_type: str = "binary",
    prior_weight: float = 1.0,
    min_samples_leaf: int = 1,
) -> dict[str, Encoder]:
    """Posterior per category over all rows.

    Categories with fewer than ``min_samples_leaf`` rows get the posterior of
    the whole table but keep their own count.
    """
    specs = _specs(df, columns)
    moments = Moments(df, _target(df, target_col), [[], *[cat for _, cat in specs]])
    return _bayesian_encoders(moments, specs, target_type, prior_weight, min_samples_leaf)


def _bayesian_encoders(
    moments: Moments,
    specs: Sequence[tuple[str, list[str]]],
    target_type: str,
    prior_weight: float,
    min_samples_leaf: int,
) -> dict[str, Encoder]:
    n, mean, m2 = F.col("n"), F.col("mean"), F.col("m2")
    whole = moments.by([]).select(
        "n", "mean", posterior(target_type, n, mean, m2, mean, prior_weight).alias("post")
    )
    overall = whole.select(F.struct("mean", "post").alias("all")).scalar()

    def flat(table: DataFrame, cat: Sequence[str]) -> DataFrame:
        return table.select(
            *cat,
            n.alias("n_samples"),
            F.col("post.mean").alias("posterior_mean"),
            F.col("post.var").alias("posterior_var"),
            F.col("post.alpha").alias("alpha_post"),
            F.col("post.beta").alias("beta_post"),
        )

    own = posterior(target_type, n, mean, m2, overall.getField("mean"), prior_weight)
    post = F.when(n < min_samples_leaf, overall.getField("post")).otherwise(own)
    found = {}
    for name, cat in specs:
        table = flat(moments.by(cat).select(*cat, "n", post.alias("post")), cat)
        found[name] = Encoder(
            name, cat, moments.sized(table, cat), flat(whole, []), "posterior_mean"
        )
    return found


def bayesian_target_encode(
    df: DataFrame,
    columns: Sequence[ColumnSpec],
    target_col: str,
    target_type: str = "binary",
    keys: str | Sequence[str] | None = None,
    n_splits: int = 5,
    seed: int = 42,
    prior_weight: float = 1.0,
    min_samples_leaf: int = 1,
    output_variance: bool = True,
    suffix: str = "",
    prefix: str = "",
    fold_col: str | None = None,
    exact_folds: bool = True,
) -> tuple[DataFrame, dict[str, Encoder]]:
    """Out-of-fold posterior mean (and variance), with the full encoder.

    Where the other folds hold fewer than ``min_samples_leaf`` rows of the
    category, the posterior of all their rows is used.
    """
    specs = _specs(df, columns)
    names = [encoded_name(name, prefix, suffix, BAYES_SUFFIX) for name, _ in specs]
    _ensure_distinct_outputs(df, names, [c for _, cat in specs for c in cat])
    fold = _fold(df, keys, n_splits, seed, fold_col, exact_folds)
    result = df.withColumn(FOLD, fold)
    moments = _fold_moments(result, _target(df, target_col), specs)

    squares = target_type == "continuous"
    n, mean, prior = F.col("n"), F.col("mean"), F.col("__prior")
    m2 = F.col("m2") if squares else F.lit(0.0)
    many = moments.by([FOLD]).count() > _WINDOW_FOLDS
    by_fold = _other_folds(moments.by([FOLD]), [], squares, many).select(
        FOLD,
        mean.alias("__prior"),
        posterior(target_type, n, mean, m2, mean, prior_weight).alias("__whole"),
    )
    by_fold = moments.sized(by_fold, [FOLD])
    enough = n >= max(int(min_samples_leaf), 1)
    own = posterior(target_type, n, mean, m2, prior, prior_weight)
    post = F.when(enough, own).otherwise(F.col("__whole"))
    for (name, cat), out in zip(specs, names):
        others = _other_folds(moments.by([*cat, FOLD]), cat, squares, many)
        seen = attach(others, by_fold, [FOLD], ["__prior", "__whole"])
        codes = seen.select(*cat, FOLD, post.alias("__post")).select(
            *cat, FOLD, F.col("__post.mean").alias("__code"), F.col("__post.var").alias("__var")
        )
        codes = moments.sized(codes, [*cat, FOLD])
        outputs = {out: "__code"}
        if output_variance:
            outputs[f"{out}_var"] = "__var"
        result = _attach_codes(result, codes, cat, outputs)
    encoders = _bayesian_encoders(moments, specs, target_type, prior_weight, min_samples_leaf)
    return result.drop(FOLD), encoders


def transform_bayesian_target_encode(
    df: DataFrame,
    encoders: dict[str, Encoder],
    columns: Sequence[ColumnSpec],
    suffix: str = "",
    prefix: str = "",
) -> DataFrame:
    """Posterior means from a fitted encoder; unknown keys get the prior's."""
    return transform_target_encode(df, encoders, columns, suffix or BAYES_SUFFIX, prefix)


# --- time-expanding target encoding -------------------------------------------------


def time_series_target_encode(
    df: DataFrame,
    columns: Sequence[ColumnSpec],
    target_col: str,
    time_col: str,
    keys: str | Sequence[str],
    target_type: str = "binary",
    prior_weight: float = 1.0,
    min_samples: int = 1,
    suffix: str = "",
    prefix: str = "",
    prior: str = "all",
    num_partitions: int | None = None,
) -> tuple[DataFrame, dict[str, Encoder]]:
    """Each row's code uses earlier rows of its category only.

    Rows are ordered by time, then key.  The prior is the mean of all rows, or
    with ``prior="past"`` of the earlier rows of any category (NULL where there
    is none).  Only keys, categories, time and target are moved; the codes are
    joined back by ``keys``, which must be unique (NULL is a key like any other).  The posterior mean has the
    same form for both target types, so running counts and sums suffice.
    """
    if target_type not in TARGET_TYPES:
        raise ValueError(f"unknown target_type {target_type!r}; known: {TARGET_TYPES}")
    if prior not in ("all", "past"):
        raise ValueError(f"unknown prior {prior!r}; known: 'all', 'past'")
    at = key_columns(keys)
    specs = _specs(df, columns)
    used = dict.fromkeys([*at, time_col, *[c for _, cat in specs for c in cat]])
    y = _target(df, target_col)
    moments = Moments(df, y, [[], *[cat for _, cat in specs]])
    narrow = df.select(*used, y.alias("__y"))
    past = {
        "__n": F.when(F.col("__y").isNotNull(), 1).otherwise(0).cast("long"),
        "__s": F.coalesce("__y", F.lit(0.0)),
    }
    # One layout by time serves every category column, and the past of all rows.
    sought = {str(i): cat for i, (_, cat) in enumerate(specs)}
    if prior == "past":
        sought["all"] = []
    narrow = running_totals_of(narrow, sought, [time_col, *at], past, num_partitions)
    if prior == "past":
        before = F.col("__s_all") / F.nullif(F.col("__n_all"), F.lit(0))
    else:
        before = moments.by([]).select("mean").scalar()
    narrow = narrow.withColumn("__prior", before)
    w = F.lit(float(prior_weight))
    codes = {}
    for i, (name, _) in enumerate(specs):
        n, total = F.col(f"__n_{i}"), F.col(f"__s_{i}")
        pulled = (w * F.col("__prior") + total) / F.nullif(w + n, F.lit(0.0))
        code = F.when(n < min_samples, F.col("__prior")).otherwise(F.coalesce(pulled, F.col("__prior")))
        codes[encoded_name(name, prefix, suffix, BAYES_SUFFIX)] = code
    outputs = list(codes)
    # Outputs may have the names of category columns.
    narrow = narrow.select(*[F.col(c).alias(f"__at_{i}") for i, c in enumerate(at)], *[c.alias(o) for o, c in codes.items()])
    narrow = narrow.select(*[F.col(f"__at_{i}").alias(c) for i, c in enumerate(at)], *outputs)
    require_unique(df.select(*at), at)
    result = attach(df.drop(*outputs), narrow, at, outputs)
    full = _bayesian_encoders(moments, specs, target_type, prior_weight, min_samples)
    return result, full
