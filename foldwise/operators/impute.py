"""Imputation with a fitted one-row model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foldwise.functions.numeric import is_missing, present
from foldwise.operators.columns import require_columns
from foldwise.operators.quantiles import exact_quantiles
from foldwise.session import cut_lineage

STRATEGIES = ("median", "mean", "constant")


def fit_imputer(
    df: DataFrame, columns: Sequence[str], strategy: str = "median", fill_value: float | str = 0.0
) -> DataFrame:
    """One row with the fill value of every column.

    Medians come from the distributed exact quantiles, so no column is gathered
    in one task.  A column without any value gets NULL.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    require_columns(df, columns)
    if strategy == "constant":
        kinds = dict(df.dtypes)
        row = df.sparkSession.range(1).select(
            *[F.lit(fill_value).cast(kinds[c]).alias(c) for c in columns]
        )
        return row
    if strategy == "mean":
        return cut_lineage(df.agg(*[F.avg(present(df, c)).alias(c) for c in columns]))
    table = exact_quantiles(df, columns, {"fill": 0.5})
    return cut_lineage(
        table.agg(*[F.max(F.when(F.col("column") == c, F.col("fill"))).alias(c) for c in columns])
    )


def apply_imputer(df: DataFrame, model: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing values from a fitted model, on any table.

    The model row enters as a scalar subquery: no join, no shuffle.
    """
    require_columns(df, columns)
    fitted = model.select(F.struct(*columns).alias("m")).scalar()
    filled = {
        c: F.when(is_missing(df, c), fitted.getField(c)).otherwise(F.col(c)) for c in columns
    }
    return df.withColumns(filled)


def fill_na(
    df: DataFrame, columns: Sequence[str], strategy: str = "median", fill_value: float | str = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``df`` and fill it; the model comes back for other tables."""
    model = fit_imputer(df, columns, strategy, fill_value)
    return apply_imputer(df, model, columns), model
