"""Cross-validated boosted trees with out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from foldwise.operators.columns import require_columns
from foldwise.operators.evaluate import binary_auc
from foldwise.plans.ordering import with_row_index
from foldwise.plans.small import attach, settle
from foldwise.session import cut_lineage

HELD_OUT = "__validation"


@dataclass(frozen=True)
class Features:
    """Fitted assembly of features; category codes are tables, not driver objects."""

    names: tuple[str, ...]
    codes: Mapping[str, DataFrame]
    sizes: Mapping[str, int]

    def assemble(self, df: DataFrame) -> DataFrame:
        """Add the vector ``__features``; columns with codes count as nominal."""
        for name, table in self.codes.items():
            df = _with_codes(df, name, table, self.sizes[name], f"{name}__index")
        inputs = [f"{n}__index" if n in self.codes else n for n in self.names]
        vectors = VectorAssembler(inputCols=inputs, outputCol="__features", handleInvalid="keep")
        return vectors.transform(df).drop(*[f"{n}__index" for n in self.codes])


@dataclass(frozen=True)
class FoldModel:
    """Boosted trees over assembled features."""

    features: Features
    trees: GBTClassificationModel


@dataclass(frozen=True)
class CrossValidation:
    """Models by fold, every row scored by every model, and feature gains."""

    models: dict[int, FoldModel]
    scored: DataFrame
    oof: DataFrame
    importance: DataFrame


def _code_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the commonest value is 0, ties by value; NULL has no code."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return with_row_index(counts, [F.col("n").desc(), F.col("value").asc()], "code").select("value", "code")


def _with_codes(df: DataFrame, column: str, table: DataFrame, size: int, output: str) -> DataFrame:
    """Add the code of ``column``; NULL and values without a code get ``size``."""
    found = attach(df, table.select(F.col("value").alias(column), F.col("code").alias("__code")), [column], ["__code"])
    nominal = {"ml_attr": {"type": "nominal", "num_vals": size + 1, "name": output}}
    code = F.coalesce(F.col("__code"), F.lit(size)).cast("double")
    return found.withColumn(output, code.alias(output, metadata=nominal)).drop("__code")


def categorical_codes(
    df: DataFrame, columns: Sequence[str], suffix: str = "__index"
) -> DataFrame:
    """Numeric codes of the listed features that are present.

    The commonest category is 0, ties by value; NULL and categories unseen in
    fitting share the code after the last.  Codes are counted, indexed and
    joined back by Spark, whatever the number of categories.
    """
    for name in [c for c in columns if c in df.columns]:
        table = settle(_code_table(df, name))
        df = _with_codes(df, name, table, table.count(), name + suffix)
    return df


def fit_features(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> Features:
    """Codes of the categorical features that are used."""
    codes = {c: settle(_code_table(df, c)) for c in categorical if c in features}
    return Features(tuple(features), codes, {c: t.count() for c, t in codes.items()})


def booster(
    target_col: str,
    weight_col: str | None = None,
    validation_col: str | None = None,
    seed: int = 42,
    params: Mapping[str, object] | None = None,
) -> GBTClassifier:
    """Boosted trees over the assembled features, stopping early if asked to (L1)."""
    trees = GBTClassifier(
        featuresCol="__features",
        labelCol=target_col,
        predictionCol="__label",
        seed=seed,
        **dict(params or {}),
    )
    trees = trees.setRawPredictionCol("__raw").setProbabilityCol("__probability")
    if weight_col:
        trees = trees.setWeightCol(weight_col)
    if validation_col:
        trees = trees.setValidationIndicatorCol(validation_col)
    return trees


def score(model: FoldModel, df: DataFrame, output_col: str = "predicted_proba") -> DataFrame:
    """Add the probability of class 1; helper columns of the model are dropped."""
    scored = _scored_by([model], df)
    return scored.select(*df.columns, F.col("__by_model")[0].alias(output_col))


def _scored_by(models: Sequence[FoldModel], df: DataFrame) -> DataFrame:
    """Add ``__by_model``, the probabilities of all models, in one pass over ``df``.

    The models share their features, so vectors are assembled once.
    """
    rows = models[0].features.assemble(df)
    found = []
    for i, model in enumerate(models):
        trees = model.trees.copy()
        trees = trees.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"__p{i}")
        rows = trees.transform(rows)
        found.append(vector_to_array(F.col(f"__p{i}")).getItem(1))
    return rows.select(*df.columns, F.array(*found).alias("__by_model"))


def score_folds(
    models: Mapping[int, FoldModel], df: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Average prediction of all fold models per row (A18): one projection, no shuffle."""
    if not models:
        raise ValueError("no fold model given")
    total = F.aggregate("__by_model", F.lit(0.0), lambda s, p: s + p)
    scored = _scored_by(list(models.values()), df)
    return scored.select(*keys, (total / len(models)).alias("prediction"))


def cross_validate_trees(
    df: DataFrame,
    features: Sequence[str],
    target_col: str,
    n_splits: int,
    fold_col: str = "fold",
    categorical: Sequence[str] = (),
    weight_col: str | None = None,
    seed: int = 42,
    params: Mapping[str, object] | None = None,
) -> CrossValidation:
    """Fit one model per fold, stopping early on the fold's own rows.

    ``oof`` holds every row once, scored by the model that did not train on it.
    Trees get as many bins as the largest category needs, unless ``params`` asks
    for more.
    """
    require_columns(df, [*features, target_col, fold_col])
    prepared = fit_features(df, features, categorical)
    options = dict(params or {})
    options["maxBins"] = max([options.get("maxBins", 32), *(n + 1 for n in prepared.sizes.values())])
    used = ["__features", target_col, fold_col, *([weight_col] if weight_col else [])]
    # Boosting passes over its input many times: assemble it once for all folds.
    assembled = cut_lineage(prepared.assemble(df).select(*used))
    # The written form forgets which entries of the vector are nominal.
    vector = prepared.assemble(df.limit(0)).schema["__features"].metadata
    assembled = assembled.withColumn("__features", F.col("__features").alias("__features", metadata=vector))
    models, importance = {}, []
    for fold in range(n_splits):
        marked = F.col(fold_col) == fold
        trees = booster(target_col, weight_col, HELD_OUT, seed, options).fit(
            assembled.withColumn(HELD_OUT, marked)
        )
        models[fold] = FoldModel(prepared, trees)
        gains = trees.featureImportances.toArray()
        importance += [(fold, name, float(g)) for name, g in zip(features, gains)]

    wide = _scored_by(list(models.values()), df)
    everything = wide.select(*df.columns, F.posexplode("__by_model").alias("__model", "predicted_proba"))
    everything = everything.withColumn(HELD_OUT, F.col(fold_col) == F.col("__model"))
    own = F.element_at("__by_model", F.col(fold_col).cast("int") + 1).alias("predicted_proba")
    oof = wide.where(F.col(fold_col).between(0, n_splits - 1)).select(*df.columns, own)
    gains = df.sparkSession.createDataFrame(
        importance, "fold int, feature string, importance double"
    )
    return CrossValidation(models, everything, oof, gains)


def fold_scores(result: CrossValidation, target_col: str) -> DataFrame:
    """(fold, train_score, valid_score): AUC of each fold's model on both sides (L3)."""
    sides = result.scored.select(
        F.col("__model").alias("__fold"), HELD_OUT, target_col, "predicted_proba"
    )
    areas = binary_auc(sides, target_col, "predicted_proba", ["__fold", HELD_OUT])
    held_out = F.col(HELD_OUT)
    return areas.groupBy(F.col("__fold").alias("fold")).agg(
        F.max(F.when(~held_out, F.col("auc"))).alias("train_score"),
        F.max(F.when(held_out, F.col("auc"))).alias("valid_score"),
    )
