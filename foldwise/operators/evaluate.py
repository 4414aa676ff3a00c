"""Scores and error samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.functions.numeric import present
from foldwise.operators.columns import path_exists, with_errors
from foldwise.plans.ordering import running_totals

SAMPLE_TYPES = ("TP", "TN", "FP", "FN")


def binary_auc(
    df: DataFrame, target_col: str, score_col: str, groups: Sequence[str] = (), output_col: str = "auc"
) -> DataFrame:
    """Exact area under the ROC curve per group, ties counting half.

    Equal scores are counted first; running counts of negatives then give the
    pairs each positive wins.  Rows that miss target or score do not count; a
    group with one class only has a NULL area.
    """
    groups = list(groups)
    target, score = present(df, target_col), present(df, score_col)
    rows = df.where(target.isNotNull() & score.isNotNull()).select(
        *groups,
        score.cast("double").alias("__score"),
        (target.cast("double") > 0).cast("long").alias("__pos"),
    )
    counts = rows.groupBy(*groups, "__score").agg(
        F.sum("__pos").alias("__p"), F.sum(1 - F.col("__pos")).alias("__q")
    )
    ranked = running_totals(counts, groups, ["__score"], {"__below": F.col("__q")})
    won = F.sum(F.col("__p") * (F.col("__below") + F.col("__q") * 0.5))
    pairs = F.sum("__p").cast("double") * F.sum("__q").cast("double")
    return ranked.groupBy(*groups).agg((won / F.nullif(pairs, F.lit(0.0))).alias(output_col))


def macro_auc(df: DataFrame, label_col: str, score_col: str, output_col: str = "macro_auc") -> DataFrame:
    """Mean AUC over the classes of two parallel arrays.

    Classes without positives or without negatives are skipped; 0.0 if none is
    left.
    """
    zipped = F.arrays_zip(F.col(label_col).alias("y"), F.col(score_col).alias("p"))
    rows = df.select(F.posexplode(zipped).alias("class", "pair")).select("class", "pair.y", "pair.p")
    return binary_auc(rows, "y", "p", ["class"]).agg(
        F.coalesce(F.avg("auc"), F.lit(0.0)).alias(output_col)
    )


def accuracy(df: DataFrame, label_col: str, predicted: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.groupBy(*groups).agg(
        F.avg((predicted == F.col(label_col)).cast("double")).alias("accuracy")
    )


def arg_max(scores: Column) -> Column:
    """0-based position of the first largest entry of an array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cv_summary(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return scores.agg(
        F.avg(score_col).alias("cv_mean"),
        F.stddev_pop(score_col).alias("cv_std"),
        F.count(score_col).alias("n_folds"),
    )


def fold_average(df: DataFrame, keys: Sequence[str], pred_col: str = "prediction") -> DataFrame:
    """Mean prediction per row over the folds that have one."""
    return df.groupBy(*keys).agg(F.avg(pred_col).alias(pred_col))


def error_samples(
    df: DataFrame,
    target_col: str,
    proba_col: str,
    keys: Sequence[str],
    n_samples: int,
    threshold: float = 0.5,
) -> DataFrame:
    """Up to ``n_samples`` rows of each confusion type.

    FP and FN with the largest errors, TP and TN with the smallest, ties by
    key; rows that miss target or score are left out.  The rank limit is pushed below the shuffle, so each task sends at most
    ``n_samples`` rows per type.
    """
    scored = df.where(present(df, target_col).isNotNull() & present(df, proba_col).isNotNull())
    judged = with_errors(scored, target_col, proba_col, threshold)
    wrong = F.col("sample_type").isin("FP", "FN")
    size = F.when(wrong, -F.col("error_magnitude")).otherwise(F.col("error_magnitude"))
    by_type = W.partitionBy("sample_type").orderBy(size, *keys)
    place = F.array_position(F.array(*[F.lit(t) for t in SAMPLE_TYPES]), F.col("sample_type"))
    return (
        judged.withColumn("sample_rank", F.row_number().over(by_type))
        .where(F.col("sample_rank") <= n_samples)
        .orderBy(place, "sample_rank")
    )


def labels_out_of_range(df: DataFrame, label_col: str, num_classes: int, sample: int = 5) -> DataFrame:
    """The smallest few distinct labels outside [0, num_classes)."""
    label = F.col(label_col)
    return (
        df.where((label < 0) | (label >= num_classes))
        .select(label_col)
        .distinct()
        .orderBy(label_col)
        .limit(sample)
    )


def readiness_report(
    df: DataFrame,
    required: Sequence[str],
    label_col: str | None = None,
    num_classes: int | None = None,
    fold_col: str | None = None,
    path_col: str | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Problems of a training table as rows (field, message, severity).

    Checks required columns, that every fold has rows on both sides, the label
    range and that all listed paths exist.  No rows means ready.
    """
    spark = df.sparkSession

    def report(field: str, message: Column, table: DataFrame) -> DataFrame:
        return table.select(
            F.lit(field).alias("field"), message.alias("message"), F.lit("error").alias("severity")
        )

    found = [
        report(c, F.lit(f"column {c} does not exist"), spark.range(1))
        for c in required
        if c not in df.columns
    ]
    if fold_col and fold_col in df.columns:
        folds = df.agg(F.count_distinct(fold_col).alias("k")).where("k < 2")
        found.append(report(fold_col, F.concat(F.lit("folds with rows: "), F.col("k")), folds))
    if label_col in df.columns and num_classes is not None:
        bad = labels_out_of_range(df, label_col, num_classes).agg(
            F.sort_array(F.collect_list(label_col)).alias("v")
        )
        outside = (F.col(label_col) < 0) | (F.col(label_col) >= num_classes)
        total = df.agg(F.count_if(outside).alias("n")).scalar()
        message = F.concat(
            F.lit(f"labels outside [0, {num_classes}): "),
            F.array_join(F.transform("v", lambda v: v.cast("string")), ", "),
            F.lit(" (rows: "), total, F.lit(")"),
        )
        found.append(report(label_col, message, bad.where(F.size("v") > 0)))
    if path_col in df.columns and listing is not None:
        flagged = path_exists(df.select(path_col), path_col, listing, "__ok")
        missing = flagged.agg(
            F.count_if(~F.col("__ok")).alias("bad"), F.count(F.lit(1)).alias("n")
        ).where("bad > 0")
        message = F.concat(F.col("bad"), F.lit("/"), F.col("n"), F.lit(" paths do not exist"))
        found.append(report(path_col, message, missing))
    if not found:
        return report("", F.lit(""), spark.range(0))
    return reduce(DataFrame.unionByName, found)
