"""Projections, predicates and label expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep ``columns`` in the given order."""
    require_columns(df, columns)
    return df.select(*columns)


def format_column(
    df: DataFrame, template: str, source_col: str, output_col: str, null_text: str | None = "None"
) -> DataFrame:
    """Put the value into every ``{source_col}`` of ``template``.

    A NULL value is written as ``null_text``; ``null_text=None`` makes the
    result NULL instead.
    """
    value = F.col(source_col).cast("string")
    if null_text is not None:
        value = F.coalesce(value, F.lit(null_text))
    pieces = template.split("{" + source_col + "}")
    parts: list[Column] = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [value, F.lit(piece)]
    return df.withColumn(output_col, F.concat(*parts))


def composite_name(spec: str | Sequence[str]) -> tuple[str, list[str]]:
    """Display name and grouping columns of a single or composite key."""
    if isinstance(spec, str):
        return spec, [spec]
    return "_".join(spec), list(spec)


def encoded_name(name: str, prefix: str = "", suffix: str = "", default_suffix: str = "") -> str:
    """Output column name of an encoder (P10)."""
    return f"{prefix}{name}{suffix or default_suffix}"


def null_indicators(df: DataFrame, columns: Sequence[str] | None = None, suffix: str = "_is_null") -> DataFrame:
    """0/1 per value: is it NULL."""
    names = columns or df.columns
    return df.select("*", *[F.col(c).isNull().cast("int").alias(c + suffix) for c in names])


def drop_nulls(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in ``column``."""
    return df.dropna(subset=[column])


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def plot_columns(df: DataFrame, max_cols: int | None = None) -> list[str]:
    """Numeric columns first, then the others; at most ``max_cols`` if given."""
    numeric = numeric_columns(df)
    return (numeric + [c for c in df.columns if c not in numeric])[:max_cols]


def binarise(probability: Column, threshold: float = 0.5) -> Column:
    """1 at or above the threshold, else 0; NULL where the score is missing."""
    given = F.nanvl(probability.cast("double"), F.lit(None).cast("double"))
    return (given >= F.lit(float(threshold))).cast("int")


def confusion_label(target: Column, label: Column) -> Column:
    """TP, TN or FP for those exact cases, FN for anything else."""
    return (
        F.when((target == 1) & (label == 1), "TP")
        .when((target == 0) & (label == 0), "TN")
        .when((target == 0) & (label == 1), "FP")
        .otherwise("FN")
    )


def with_errors(
    df: DataFrame, target_col: str, proba_col: str, threshold: float = 0.5
) -> DataFrame:
    """Predicted label, correctness, error size and confusion type."""
    target, proba = F.col(target_col), F.col(proba_col)
    return (
        df.withColumn("predicted_label", binarise(proba, threshold))
        .withColumn("is_correct", (F.col("predicted_label") == target).cast("int"))
        .withColumn("error_magnitude", F.abs(proba - target))
        .withColumn("sample_type", confusion_label(target, F.col("predicted_label")))
    )


def sample_weight(
    df: DataFrame,
    target_col: str,
    weight_col: str | None = None,
    class_weight: Mapping[int, float] | None = None,
    output_col: str = "sample_weight",
) -> DataFrame:
    """An existing weight column first, else weights by class (1.0 if not listed),
    else no weight column at all (P17)."""
    if weight_col and weight_col in df.columns:
        return df.withColumn(output_col, F.col(weight_col).cast("double"))
    if class_weight is None:
        return df
    weight = F.lit(1.0)
    for value, w in class_weight.items():
        weight = F.when(F.col(target_col) == int(value), F.lit(float(w))).otherwise(weight)
    return df.withColumn(output_col, weight)


def path_exists(
    df: DataFrame, path_col: str, listing: DataFrame, output_col: str = "__image_valid__"
) -> DataFrame:
    """Flag rows whose path is in ``listing(path)`` (P19): a join, not a file call per row."""
    known = listing.select(F.col("path").alias("__path")).where("__path IS NOT NULL").distinct()
    return (
        df.join(known, F.col(path_col) == F.col("__path"), "left")
        .withColumn(output_col, F.col("__path").isNotNull())
        .drop("__path")
    )

