"""Combining models over a long table (key, model, prediction)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from foldwise.functions.numeric import present
from foldwise.operators.columns import binarise
from foldwise.plans.ordering import running_totals
from foldwise.plans.small import attach, settle


def mean_ensemble(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain average per row (L4)."""
    return predictions.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def weighted_mean_ensemble(
    predictions: DataFrame, keys: Sequence[str], weights: Mapping[str, float]
) -> DataFrame:
    """``sum(w * p) / sum(w)`` over the models that scored a row.

    Every model needs a weight.  A row that no weighted model scored is NULL.
    """
    models = {r["model"] for r in predictions.select("model").distinct().limit(len(weights) + 1).collect()}
    if models != set(weights):
        raise ValueError(f"weights are for {sorted(weights)} but models are {sorted(models)}")
    total = float(sum(weights.values()))
    if total == 0:
        raise ValueError("weights sum to zero")
    weight = F.lit(None).cast("double")
    for model, w in weights.items():
        weight = F.when(F.col("model") == model, F.lit(float(w) / total)).otherwise(weight)
    given = present(predictions, "prediction")
    used = F.sum(F.when(given.isNotNull(), weight))
    return predictions.groupBy(*keys).agg(
        (F.sum(given * weight) / F.nullif(used, F.lit(0.0))).alias("prediction")
    )


def scaled_ranks(predictions: DataFrame) -> DataFrame:
    """Replace predictions by average-tie ranks per model, scaled to [0, 1].

    Equal predictions are counted first, so a very common value is one row in
    the ranking; a model with a single row gets 0.  Missing predictions are not
    ranked and stay NULL.
    """
    predictions = predictions.withColumn("prediction", present(predictions, "prediction"))
    given = predictions.where("prediction IS NOT NULL")
    counts = given.groupBy("model", "prediction").agg(F.count(F.lit(1)).alias("__c"))
    placed = running_totals(counts, ["model"], ["prediction"], {"__before": F.col("__c")})
    # One row per model.
    sizes = settle(given.groupBy("model").agg(F.count(F.lit(1)).alias("__n")))
    placed = attach(placed, sizes, ["model"], ["__n"])
    middle = F.col("__before") + (F.col("__c") - 1) / 2.0
    scaled = F.when(F.col("__n") > 1, middle / (F.col("__n") - 1)).otherwise(0.0)
    ranks = placed.select("model", "prediction", scaled.alias("__rank"))
    ranked = attach(predictions, ranks, ["model", "prediction"], ["__rank"])
    return ranked.withColumn("prediction", F.col("__rank")).drop("__rank")


def rank_average_ensemble(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average of the scaled ranks over models."""
    return mean_ensemble(scaled_ranks(predictions), keys)


# Strategies by name; add your own function to extend them.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "mean": mean_ensemble,
    "weighted_mean": weighted_mean_ensemble,
    "rank_average": rank_average_ensemble,
}


def ensemble(
    predictions: DataFrame,
    keys: Sequence[str],
    strategy: str = "mean",
    extra: Mapping[str, Callable[..., DataFrame]] | None = None,
    **options: object,
) -> DataFrame:
    known = {**STRATEGIES, **(extra or {})}
    if strategy not in known:
        raise ValueError(f"unknown ensemble {strategy!r}; known: {sorted(known)}")
    return known[strategy](predictions, keys, **options)


def output_tables(
    predictions: DataFrame, id_col: str, target_name: str, threshold: float | None = None
) -> dict[str, DataFrame]:
    """Tables of the final output (L7): probabilities, and 0/1 labels with a threshold."""
    proba = predictions.select(id_col, F.col("prediction").alias(target_name))
    if threshold is None:
        return {"submission": proba}
    label = binarise(F.col(target_name), threshold)
    return {"submission": proba.withColumn(target_name, label), "submission_proba": proba}
