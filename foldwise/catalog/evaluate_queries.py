"""A17-A24, L: scores, ensembles, learning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foldwise.catalog.registry import (
    FINISHED, JUDGED, finished_orders, judged, kfold_sql, query, rounded, table,
)
from foldwise.operators.ensemble import ensemble, output_tables
from foldwise.operators.evaluate import (
    accuracy, arg_max, binary_auc, cv_summary, fold_average, labels_out_of_range, macro_auc,
    readiness_report,
)
from foldwise.operators.learn import HELD_OUT, cross_validate_trees, fold_scores, score, score_folds
from foldwise.operators.split import kfold
from foldwise.plans.ordering import running_totals


def _auc_sql(rows: str, group: str) -> str:
    """Rank-sum area per group of ``rows(group, y, p)``."""
    return f"""SELECT {group}, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
                 / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY p)
                      + (count(*) OVER (PARTITION BY {group}, p) - 1) / 2.0 AS r FROM {rows}) GROUP BY {group}"""


FOLD_AUC = f"""{JUDGED}, f AS (SELECT {kfold_sql('doc_id')} AS fold, toxic AS y, round(score, 2) AS p FROM judged),
  a AS ({_auc_sql('f', 'fold')})"""


def _fold_auc(spark, d):
    rows = kfold(judged(spark, d).withColumn("score", F.round("score", 2)), "doc_id")
    return binary_auc(rows, "toxic", "score", ["fold"])


@query("a19_auc_by_fold", f"WITH {FOLD_AUC} SELECT fold, round(auc, 8) AS auc FROM a")
def _auc(spark, d):
    return rounded(_fold_auc(spark, d), 8, "auc")


@query(
    "a19_auc_orders",
    f"""WITH f AS (SELECT 'all' AS g, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
                          CAST(o_custkey % 100 AS DOUBLE) AS p FROM orders)
        SELECT round(auc, 8) AS auc FROM ({_auc_sql('f', 'g')})""",
)
def _auc_orders(spark, d):
    rows = table(spark, d, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_custkey") % 100).alias("p")
    )
    return rounded(binary_auc(rows, "y", "p"), 8, "auc")


@query(
    "a17_cv_summary",
    f"""WITH {FOLD_AUC} SELECT round(avg(auc), 8) AS cv_mean, round(stddev_pop(auc), 8) AS cv_std,
        count(auc) AS n_folds FROM a""",
)
def _summary(spark, d):
    return rounded(cv_summary(_fold_auc(spark, d), "auc"), 8, "cv_mean", "cv_std")


@query(
    "a18_fold_average",
    """SELECT user_id, round(avg(value), 6) AS prediction FROM events GROUP BY 1""",
)
def _fold_average(spark, d):
    rows = table(spark, d, "events")
    found = fold_average(rows.withColumnRenamed("value", "prediction"), ["user_id"])
    return rounded(found, 6, "prediction")


@query(
    "a20_macro_auc",
    f"""WITH f AS (SELECT class, CAST(label = class AS INTEGER) AS y, round(embedding[class + 1]::DOUBLE, 3) AS p
                   FROM embeddings, (SELECT unnest(range(64)) AS class))
        SELECT round(coalesce(avg(auc), 0), 8) AS macro_auc FROM ({_auc_sql('f', 'class')})""",
)
def _macro(spark, d):
    classes = F.sequence(F.lit(0), F.size("embedding") - 1)
    rows = table(spark, d, "embeddings").select(
        F.transform(classes, lambda c: (F.col("label") == c).cast("int")).alias("y"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("p"),
    )
    return rounded(macro_auc(rows, "y", "p"), 8, "macro_auc")


@query(
    "a21_accuracy",
    """SELECT label, round(avg(CAST(list_position(embedding, list_max(embedding)) - 1 = label AS DOUBLE)), 8)
       AS accuracy FROM embeddings GROUP BY 1""",
)
def _accuracy(spark, d):
    predicted = arg_max(F.col("embedding"))
    return rounded(accuracy(table(spark, d, "embeddings"), "label", predicted, ["label"]), 8, "accuracy")


@query(
    "a23_label_range",
    "SELECT DISTINCT label FROM embeddings WHERE label < 0 OR label >= 4 ORDER BY 1 LIMIT 5",
)
def _label_range(spark, d):
    return labels_out_of_range(table(spark, d, "embeddings"), "label", 4)


@query(
    "a24_readiness",
    """SELECT 'image_path' AS field, 'column image_path does not exist' AS message, 'error' AS severity
       UNION ALL SELECT 'label', 'labels outside [0, 8): ' ||
         (SELECT string_agg(label, ', ' ORDER BY label) FROM (SELECT DISTINCT label FROM embeddings WHERE label >= 8
          ORDER BY 1 LIMIT 5)) || ' (rows: ' || (SELECT count(*) FROM embeddings WHERE label >= 8) || ')', 'error'
       UNION ALL SELECT 'name', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels))
         || '/' || (SELECT count(*) FROM embeddings) || ' paths do not exist', 'error'""",
)
def _readiness(spark, d):
    name = F.concat(F.lit("v"), F.col("vec_id"))
    rows = table(spark, d, "embeddings").select("vec_id", "label", name.alias("name"))
    listing = table(spark, d, "labels").select(F.concat(F.lit("v"), F.col("doc_id")).alias("path"))
    return readiness_report(
        rows, ["label", "image_path"], "label", 8, path_col="name", listing=listing
    )


MODELS = """m AS (
  SELECT o_orderkey, 'a' AS model, o_totalprice / 500000 AS p FROM orders
  UNION ALL SELECT o_orderkey, 'b', (o_custkey % 100) / 100 FROM orders
  UNION ALL SELECT o_orderkey, 'c', (o_orderkey * 7 % 1000) / 1000 FROM orders)"""


def _models(spark, d):
    """Three scores per order; two of them with many ties."""
    scores = F.array(
        F.struct(F.lit("a").alias("model"), (F.col("o_totalprice") / 500000).alias("prediction")),
        F.struct(F.lit("b").alias("model"), (F.col("o_custkey") % 100 / 100).alias("prediction")),
        F.struct(F.lit("c").alias("model"), (F.col("o_orderkey") * 7 % 1000 / 1000).alias("prediction")),
    )
    return table(spark, d, "orders").select("o_orderkey", F.inline(scores))


@query("l4_ensemble_mean", f"WITH {MODELS} SELECT o_orderkey, round(avg(p), 8) AS prediction FROM m GROUP BY 1")
def _mean(spark, d):
    return rounded(ensemble(_models(spark, d), ["o_orderkey"], "mean"), 8, "prediction")


@query(
    "l5_ensemble_weighted",
    f"""WITH {MODELS} SELECT o_orderkey,
        round(sum(p * CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END::DOUBLE), 8) AS prediction
        FROM m GROUP BY 1""",
)
def _weighted(spark, d):
    weights = {"a": 5.0, "b": 3.0, "c": 2.0}
    found = ensemble(_models(spark, d), ["o_orderkey"], "weighted_mean", weights=weights)
    return rounded(found, 8, "prediction")


GAPS = """g AS (SELECT o_orderkey, model, CASE WHEN (o_orderkey + ascii(model)) % 3 > 0 THEN p END AS p FROM m)"""


def _models_with_gaps(spark, d):
    """Every model leaves out a third of the orders: NULL for some, NaN for others."""
    there = (F.col("o_orderkey") + F.ascii("model")) % 3 > 0
    blank = F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan")))
    return _models(spark, d).withColumn("prediction", F.when(there, F.col("prediction")).otherwise(blank))


@query(
    "l5_ensemble_weighted_gaps",
    f"""WITH {MODELS}, {GAPS}, w AS (SELECT *, CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM g)
        SELECT o_orderkey, round(sum(p * w) / nullif(sum(w) FILTER (p IS NOT NULL), 0), 6) AS prediction FROM w GROUP BY 1""",
)
def _weighted_gaps(spark, d):
    weights = {"a": 5.0, "b": 3.0, "c": 2.0}
    found = ensemble(_models_with_gaps(spark, d), ["o_orderkey"], "weighted_mean", weights=weights)
    return rounded(found, 6, "prediction")


@query(
    "l6_ensemble_rank_gaps",
    f"""WITH {MODELS}, {GAPS}, r AS (
          SELECT o_orderkey, model, (rank() OVER (PARTITION BY model ORDER BY p) - 1
                  + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0)
                 / (count(*) OVER (PARTITION BY model) - 1) AS s FROM g WHERE p IS NOT NULL)
        SELECT o_orderkey, round(avg(s), 8) AS prediction FROM g LEFT JOIN r USING (o_orderkey, model) GROUP BY 1""",
)
def _rank_gaps(spark, d):
    return rounded(ensemble(_models_with_gaps(spark, d), ["o_orderkey"], "rank_average"), 8, "prediction")


@query(
    "a19_auc_with_gaps",
    f"""WITH f AS (SELECT 'all' AS g, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_custkey % 100 AS DOUBLE) AS p
                   FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
        SELECT round(auc, 8) AS auc FROM ({_auc_sql('f', 'g')})""",
)
def _auc_gaps(spark, d):
    nan = F.lit(float("nan"))
    key, target = F.col("o_orderkey"), (F.col("o_orderstatus") == "F").cast("double")
    rows = table(spark, d, "orders").select(
        F.when(key % 5 == 0, nan).otherwise(target).alias("y"),
        F.when(key % 7 == 0, nan).otherwise((F.col("o_custkey") % 100).cast("double")).alias("p"),
    )
    return rounded(binary_auc(rows, "y", "p"), 8, "auc")


@query(
    "l6_ensemble_rank",
    f"""WITH {MODELS}, r AS (
          SELECT o_orderkey, (rank() OVER (PARTITION BY model ORDER BY p) - 1
                  + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0)
                 / (count(*) OVER (PARTITION BY model) - 1) AS s FROM m)
        SELECT o_orderkey, round(avg(s), 8) AS prediction FROM r GROUP BY 1""",
)
def _rank(spark, d):
    return rounded(ensemble(_models(spark, d), ["o_orderkey"], "rank_average"), 8, "prediction")


@query(
    "l7_thresholded_output",
    f"""WITH {MODELS} SELECT o_orderkey, CAST(avg(p) >= 0.5 AS INTEGER) AS finished FROM m GROUP BY 1""",
)
def _threshold(spark, d):
    merged = ensemble(_models(spark, d), ["o_orderkey"])
    return output_tables(merged, "o_orderkey", "finished", 0.5)["submission"]


FEATURES = ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"]
TREES = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.2}


def _trained(spark, d):
    rows = kfold(finished_orders(spark, d), "o_orderkey", 3)
    return rows, cross_validate_trees(
        rows, FEATURES, "finished", 3, categorical=["o_orderpriority", "c_mktsegment"], params=TREES
    )


@query(
    "l1_l2_gbt_oof",
    f"""WITH {FINISHED} SELECT o_orderkey, {kfold_sql('o_orderkey', 3)} AS fold, finished, o_totalprice, c_acctbal,
        o_orderpriority, c_mktsegment, TRUE AS is_probability FROM finished_orders""",
)
def _oof(spark, d):
    """Every order once, with its own fold and target and a probability."""
    _, result = _trained(spark, d)
    probability = F.col("predicted_proba").between(0.0, 1.0)
    return result.oof.select("o_orderkey", "fold", "finished", *FEATURES, probability.alias("is_probability"))


def rank_areas(scored):
    """(fold, train, valid): areas from rank sums with mean ranks of ties.

    Equal scores are counted first, and the rows before them by range partitions: a window over the
    ranks of a side would sort a sixth of all scores in one task.
    """
    side = ["fold", "held_out"]
    ties = scored.groupBy(*side, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    placed = running_totals(ties, side, ["p"], {"before": F.col("n")})
    mean_rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    ones, rows = F.sum("ones"), F.sum("n")
    area = (F.sum(F.col("ones") * mean_rank) - ones * (ones + 1) / 2.0) / (ones * (rows - ones))
    return placed.groupBy(*side).agg(area.alias("area")).groupBy("fold").agg(
        F.max(F.when(~F.col("held_out"), F.col("area"))).alias("train"),
        F.max(F.when(F.col("held_out"), F.col("area"))).alias("valid"),
    )


@query(
    "l3_gbt_fold_scores",
    """SELECT CAST(unnest(range(3)) AS INTEGER) AS fold, TRUE AS train_learned, TRUE AS valid_is_area,
         TRUE AS train_matches, TRUE AS valid_matches""",
)
def _scores(spark, d):
    """A model ranks its own rows better than chance; the target is noise to it elsewhere.

    Areas are compared with rank sums over the same scored rows.
    """
    result = _trained(spark, d)[1]
    ranked = rank_areas(result.scored.select(
        F.col("__model").alias("fold"), F.col(HELD_OUT).alias("held_out"), F.col("finished").alias("y"),
        F.col("predicted_proba").alias("p"),
    ))
    found = fold_scores(result, "finished").join(ranked, "fold")
    return found.select(
        F.col("fold").cast("int").alias("fold"), (F.col("train_score") > 0.5).alias("train_learned"),
        F.col("valid_score").between(0.25, 0.75).alias("valid_is_area"),
        (F.abs(F.col("train_score") - F.col("train")) < 1e-9).alias("train_matches"),
        (F.abs(F.col("valid_score") - F.col("valid")) < 1e-9).alias("valid_matches"),
    )


@query(
    "l1_gbt_learns",
    "SELECT CAST(unnest(range(3)) AS INTEGER) AS fold, TRUE AS train_learned, TRUE AS valid_learned",
)
def _learns(spark, d):
    """A target that follows from a category of a hundred values is learned on both sides."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 100).alias("code"), "o_totalprice",
        (F.col("o_custkey") % 100 % 3 == 0).cast("int").alias("y"),
    )
    result = cross_validate_trees(
        kfold(orders, "o_orderkey", 3), ["code", "o_totalprice"], "y", 3, categorical=["code"], params=TREES
    )
    found = fold_scores(result, "y")
    return found.select(
        "fold", (F.col("train_score") > 0.99).alias("train_learned"),
        (F.col("valid_score") > 0.95).alias("valid_learned"),
    )


@query(
    "l8_gbt_fold_scoring",
    "SELECT o_orderkey, 3::BIGINT AS models, TRUE AS is_probability, TRUE AS is_average FROM orders",
)
def _scoring(spark, d):
    """The one-pass average against every model's own scores."""
    rows, result = _trained(spark, d)
    each = [score(m, rows, "p").select("o_orderkey", "p") for m in result.models.values()]
    by_model = reduce(DataFrame.unionByName, each).groupBy("o_orderkey").agg(
        F.avg("p").alias("average"), F.count("p").alias("models")
    )
    scored = score_folds(result.models, rows, ["o_orderkey"]).join(by_model, "o_orderkey")
    return scored.select(
        "o_orderkey", "models", F.col("prediction").between(0.0, 1.0).alias("is_probability"),
        (F.abs(F.col("prediction") - F.col("average")) < 1e-12).alias("is_average"),
    )


@query(
    "a22_feature_importance",
    "SELECT CAST(unnest(range(3)) AS INTEGER) AS fold, 4::BIGINT AS n_features, TRUE AS none_negative, TRUE AS adds_to_one",
)
def _importance(spark, d):
    gains = _trained(spark, d)[1].importance
    return gains.groupBy("fold").agg(
        F.count_distinct("feature").alias("n_features"),
        F.bool_and(F.col("importance") >= 0).alias("none_negative"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_to_one"),
    )
