"""Arithmetic with IEEE results, as the source tables of a feature job expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NAN = float("nan")
INF = float("inf")

BINARY_OPERATIONS = ("add", "subtract", "multiply", "divide")


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing means NULL, or NaN in a floating column."""
    kind = dict(df.dtypes)[name]
    column = F.col(name)
    if kind in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into NULL, so that aggregates skip it."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.nanvl(F.col(name), F.lit(None).cast("double"))
    return F.col(name)


def true_divide(a: Column, b: Column) -> Column:
    """Floating division where x/0 is +-inf and 0/0 is nan instead of an error."""
    num, den = a.cast("double"), b.cast("double")
    at_zero = (
        F.when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    )
    at_zero = F.when(F.isnan(num), F.lit(NAN)).otherwise(at_zero)
    # 1/-0.0 is -inf; Spark cannot tell the zeros apart by comparison, text can.
    signed = F.when(den.cast("string") == "-0.0", -at_zero).otherwise(at_zero)
    return (
        F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
        .when(den == 0, signed)
        .otherwise(F.try_divide(num, den))
    )


def log_one_plus(a: Column) -> Column:
    """ln(1 + a) with -inf at -1 and nan below it (Spark alone gives NULL)."""
    x = a.cast("double")
    return (
        F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))
    )


def arithmetic(
    df: DataFrame, operation: str, col_a: str, output_col: str, col_b: str | None = None
) -> DataFrame:
    """Add or replace ``output_col`` with ``col_a <operation> col_b``."""
    if operation in BINARY_OPERATIONS:
        if col_b is None:
            raise ValueError(f"{operation!r} needs col_b")
        a, b = F.col(col_a), F.col(col_b)
        value = {
            "add": lambda: a + b,
            "subtract": lambda: a - b,
            "multiply": lambda: a * b,
            "divide": lambda: true_divide(a, b),
        }[operation]()
    elif operation == "log1p":
        value = log_one_plus(F.col(col_a))
    else:
        raise ValueError(f"unknown operation: {operation!r}")
    return df.withColumn(output_col, value)
