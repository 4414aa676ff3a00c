"""Cross-validation as one column per row instead of k index lists.

A split adds ``fold`` (train of fold i = ``fold <> i``, test = ``fold = i``) or,
for expanding time splits, ``block`` (test of fold i = block i + 1, train =
blocks up to i).  Assign it last, on the final table: it is a projection or one
join with a small table, so recomputing it after rows changed costs little.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.functions.hashing import hash_fold, key_columns, shuffle_order
from foldwise.plans.brackets import rows_at_ranks
from foldwise.plans.cuts import cut_points, cuts_passed, even_cut_ranks
from foldwise.plans.dealing import deal
from foldwise.plans.ordering import running_totals, with_row_index
from foldwise.plans.small import attach, settle
from foldwise.session import cut_lineage

DEFAULT_SPLITS = 5
DEFAULT_SEED = 42
# Classes that a stratified group split balances one by one.
CLASSES = 32


def _check_splits(n_splits: int) -> None:
    if n_splits < 2:
        raise ValueError(f"n_splits must be at least 2, got {n_splits}")


def kfold_expression(
    df: DataFrame, keys: str | Sequence[str], n_splits: int = DEFAULT_SPLITS, seed: int = DEFAULT_SEED
) -> Column:
    """Exact shuffled k-fold as an expression over the key columns alone (F1).

    Only the ``n_splits - 1`` thresholds come to the driver.
    """
    _check_splits(n_splits)
    order = shuffle_order(keys, seed)
    found = cut_points(df, [], order, even_cut_ranks(n_splits)).first()
    total = found["n"] or 0
    if total < n_splits:
        raise ValueError(f"cannot make {n_splits} folds of {total} rows")
    cuts = [F.lit(found[f"cut_{i}"]) for i in range(n_splits - 1)]
    return cuts_passed(order, cuts).cast("int")


def kfold(
    df: DataFrame,
    keys: str | Sequence[str],
    n_splits: int = DEFAULT_SPLITS,
    seed: int = DEFAULT_SEED,
    fold_col: str = "fold",
    exact: bool = True,
) -> DataFrame:
    """Shuffled k-fold; ``exact`` makes sizes differ by at most one (F1)."""
    _check_splits(n_splits)
    if not exact:
        return df.withColumn(fold_col, hash_fold(keys, n_splits, seed))
    return df.withColumn(fold_col, kfold_expression(df, keys, n_splits, seed))


def stratified_kfold(
    df: DataFrame,
    keys: str | Sequence[str],
    target_col: str,
    n_splits: int = DEFAULT_SPLITS,
    seed: int = DEFAULT_SEED,
    fold_col: str = "fold",
) -> DataFrame:
    """Sizes differ by at most one per class and in total.

    Each class is cut into even runs of its own shuffle; the classes take turns
    in which fold gets their surplus rows.
    """
    _check_splits(n_splits)
    order = shuffle_order(keys, seed)
    classes = cut_points(df, [target_col], order, even_cut_ranks(n_splits))
    surplus = {"__turn": F.col("n") % n_splits}
    classes = settle(running_totals(classes, [], [target_col], surplus))
    cuts = [f"cut_{i}" for i in range(n_splits - 1)]
    joined = attach(df, classes, [target_col], ["__turn", *cuts])
    run = cuts_passed(order, [F.col(c) for c in cuts])
    return joined.withColumn(
        fold_col, ((F.col("__turn") % n_splits + run) % n_splits).cast("int")
    ).drop("__turn", *cuts)


def _snake(position: Column, n_splits: int) -> Column:
    """Deal positions 0,1,2,... to folds 0..k-1, k-1..0, 0..k-1, ..."""
    step = position % (2 * n_splits)
    return F.when(step < n_splits, step).otherwise(2 * n_splits - 1 - step)


def _attach_groups(df: DataFrame, dealt: DataFrame, group_col: str, fold_col: str) -> DataFrame:
    table = settle(dealt.select(group_col, F.col("__fold").cast("int").alias("__fold")))
    return attach(df, table, [group_col], ["__fold"]).withColumnRenamed("__fold", fold_col)


def _groups_alone(sizes: DataFrame, group_col: str, n_splits: int) -> int:
    """How many of the largest groups take a fold of their own; too few groups raise."""
    facts = sizes.agg(F.sum("__size").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    if facts["groups"] < n_splits:
        raise ValueError(f"cannot make {n_splits} folds of {facts['groups']} groups")
    alone, rest = 0, facts["rows"]
    by_size = [F.col("__size").desc(), F.col(group_col).asc_nulls_first()]
    for row in sizes.orderBy(*by_size).limit(n_splits - 1).select("__size").collect():
        if row["__size"] * (n_splits - alone) < rest:
            break
        alone, rest = alone + 1, rest - row["__size"]
    return alone


def group_kfold(
    df: DataFrame,
    group_col: str,
    n_splits: int = DEFAULT_SPLITS,
    fold_col: str = "fold",
) -> DataFrame:
    """No group is split; fold sizes are near even.

    Groups are dealt by size rank.  A group at least as large as the mean
    load of the folds still open takes a fold of its own first; there can be at
    most ``n_splits`` of those, so only that many sizes come to the driver.
    """
    _check_splits(n_splits)
    sizes = cut_lineage(df.groupBy(group_col).agg(F.count(F.lit(1)).alias("__size")))
    by_size = [F.col("__size").desc(), F.col(group_col).asc_nulls_first()]
    alone = _groups_alone(sizes, group_col, n_splits)
    place = F.col("__place")
    dealt = with_row_index(sizes, by_size, "__place").withColumn(
        "__fold",
        F.when(place < alone, place).otherwise(alone + _snake(place - alone, n_splits - alone)),
    )
    return _attach_groups(df, dealt, group_col, fold_col)


def stratified_group_kfold(
    df: DataFrame,
    target_col: str,
    group_col: str,
    n_splits: int = DEFAULT_SPLITS,
    fold_col: str = "fold",
) -> DataFrame:
    """No group is split, and every class is spread over the folds.

    A group at least as large as the mean load of the folds still open takes a fold
    of its own.  Over the other folds the commonest class differs by at most its
    largest count in one of the groups dealt there, and so does the second; with more
    than two classes the others are kept as even as whole groups allow, without a
    proven bound.  The ``CLASSES`` commonest classes count one by one, all others
    together as one class.
    """
    _check_splits(n_splits)
    by_count = [F.col("__n").desc(), F.col(target_col).asc_nulls_first()]
    commonest = df.groupBy(target_col).agg(F.count(F.lit(1)).alias("__n")).orderBy(*by_count)
    classes = [F.col(target_col).eqNullSafe(F.lit(r[0])) for r in commonest.limit(CLASSES).collect()]
    counts = [F.count_if(c) for c in classes]
    if len(classes) == CLASSES:
        counts.append(F.count_if(~reduce(Column.__or__, classes)))
    groups = cut_lineage(
        df.groupBy(group_col).agg(F.count(F.lit(1)).alias("__size"), F.array(*counts).alias("__counts"))
    )
    alone = _groups_alone(groups, group_col, n_splits)
    first = groups.orderBy(F.col("__size").desc(), F.col(group_col).asc_nulls_first()).limit(alone)
    place = F.row_number().over(W.orderBy(F.col("__size").desc(), F.col(group_col).asc_nulls_first()))
    own = settle(first.select(group_col, (place - 1).alias("__own")))  # fewer than n_splits rows
    marked = attach(groups, own, [group_col], ["__own"])
    order = [F.col("__counts")[0].desc(), F.col("__size").desc(), F.col(group_col).asc_nulls_first()]
    others = marked.where("__own IS NULL").select(group_col, "__size", "__counts")
    dealt = deal(others, "__counts", order, n_splits - alone)
    folds = dealt.select(group_col, (F.col("__fold") + alone).alias("__fold")).unionByName(
        marked.where("__own IS NOT NULL").select(group_col, F.col("__own").alias("__fold"))
    )
    return _attach_groups(df, folds, group_col, fold_col)


def leave_one_group_out(df: DataFrame, group_col: str, fold_col: str = "fold") -> DataFrame:
    """One fold per group, numbered in group order."""
    groups = with_row_index(df.select(group_col).distinct(), [group_col], "__fold")
    return _attach_groups(df, groups, group_col, fold_col)


def time_series(
    df: DataFrame,
    time_col: str,
    keys: str | Sequence[str],
    n_splits: int = DEFAULT_SPLITS,
    block_col: str = "block",
) -> DataFrame:
    """Expanding time split (F2): the last ``n_splits`` equal blocks are tests.

    Only times and keys near the block borders are sorted; whole rows are
    compared with ``n_splits`` thresholds in place.
    """
    _check_splits(n_splits)
    at = key_columns(keys)
    narrow = df.select(time_col, *at)
    total = narrow.count()
    size = total // (n_splits + 1)
    if size == 0:
        raise ValueError(f"cannot make {n_splits} time folds of {total} rows")
    starts = [total - (n_splits - i) * size for i in range(n_splits)]
    thresholds = rows_at_ranks(narrow, time_col, at, starts, total)
    position = F.struct(time_col, *at)
    cuts = [thresholds.getField(f"c{i}") for i in range(n_splits)]
    return df.withColumn(block_col, cuts_passed(position, cuts).cast("int"))


def assign_folds(df: DataFrame, strategy: str = "none", **options: object) -> DataFrame:
    """Pick a split by name; ``none`` leaves the table as it is."""
    strategies = {
        "kfold": kfold,
        "time_series": time_series,
        "stratified_kfold": stratified_kfold,
        "group_kfold": group_kfold,
        "stratified_group_kfold": stratified_group_kfold,
        "leave_one_group_out": leave_one_group_out,
    }
    if strategy == "none":
        return df
    if strategy not in strategies:
        raise ValueError(f"unknown split {strategy!r}; known: {sorted(strategies)}")
    return strategies[strategy](df, **options)


def training_rows(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """Training rows of one fold."""
    return df.where(F.col(fold_col) != fold)


def held_out_rows(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """Test rows of one fold."""
    return df.where(F.col(fold_col) == fold)


def time_training_rows(df: DataFrame, fold: int, block_col: str = "block") -> DataFrame:
    return df.where(F.col(block_col) <= fold)


def time_held_out_rows(df: DataFrame, fold: int, block_col: str = "block") -> DataFrame:
    return df.where(F.col(block_col) == fold + 1)
