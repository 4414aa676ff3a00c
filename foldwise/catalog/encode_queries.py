"""Target encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.catalog.registry import (
    FINISHED, finished_orders, kfold_sql, query, rounded, table,
)
from foldwise.operators.encode import (
    bayesian_target_encode, fit_bayesian_encoder, fit_target_encoder, target_encode,
    time_series_target_encode, transform_bayesian_target_encode, transform_target_encode,
)
from foldwise.operators.split import kfold, held_out_rows, training_rows
from foldwise.plans.recipe import compose


def finished_rate(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold smoothed rate of finished orders by priority and segment."""
    rows = kfold(finished_orders(spark, d), "o_orderkey")
    spec = [["o_orderpriority", "c_mktsegment"]]
    coded, _ = target_encode(rows, spec, "finished", fold_col="fold", suffix="_te")
    te = F.round("o_orderpriority_c_mktsegment_te", 8).alias("te")
    return coded.select("o_orderkey", "fold", te)


def _oof_sql(cats: str, target: str, source: str, key: str, k: int = 5) -> str:
    """t: rows with fold; g: moments of the other folds; c: the same per category."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in cats.split(", "))
    a_cats = ", ".join(f"a.{c}" for c in cats.split(", "))
    moments = "count(b.y) AS n, avg(b.y) AS m, coalesce(var_pop(b.y) * count(b.y), 0) AS ss"
    return f"""t AS (SELECT *, {target}::DOUBLE AS y, {kfold_sql(key, k)} AS fold FROM {source}),
      g AS (SELECT a.fold, avg(b.y) AS prior, {moments.replace('AS n', 'AS gn').replace('AS m,', 'AS gm,').replace('AS ss', 'AS gss')}
            FROM (SELECT DISTINCT fold FROM t) a JOIN t b ON a.fold <> b.fold GROUP BY 1),
      c AS (SELECT {a_cats}, a.fold, {moments} FROM (SELECT DISTINCT {cats}, fold FROM t) a
            LEFT JOIN t b ON {on} AND a.fold <> b.fold GROUP BY ALL),
      e AS (SELECT * FROM t JOIN c USING ({cats}, fold) JOIN g USING (fold))"""


RATE = _oof_sql("o_orderpriority, c_mktsegment", "finished", "finished_orders", "o_orderkey")


@query(
    "e3_te_oof",
    f"""WITH {FINISHED}, {RATE} SELECT o_orderkey, fold,
        round(CASE WHEN n > 0 THEN (n * m + prior) / (n + 1) ELSE prior END, 8) AS te FROM e""",
)
def _te_oof(spark, d):
    return finished_rate(spark, d)


@query(
    "e3_te_oof_rare_categories",
    f"""WITH {_oof_sql('o_custkey', 'o_totalprice', 'orders', 'o_orderkey')}
        SELECT o_orderkey, round(CASE WHEN n > 0 THEN (n * m + 10 * prior) / (n + 10) ELSE prior END, 4) AS te FROM e""",
)
def _te_rare(spark, d):
    coded, _ = target_encode(
        table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", smoothing=10.0, suffix="_te"
    )
    return coded.select("o_orderkey", F.round("o_custkey_te", 4).alias("te"))


@query(
    "p10_encoded_names",
    """WITH g AS (SELECT avg(o_totalprice) AS m FROM orders),
       c AS (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1)
       SELECT o_orderkey, round((s + 1.1 * m) / (n + 1.1), 3) AS o_orderstatus,
              round((s + 1.1 * m) / (n + 1.1), 3) AS enc_o_orderstatus_x FROM orders JOIN c USING (o_orderstatus), g""",
)
def _names(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    model = fit_target_encoder(orders, ["o_orderstatus"], "o_totalprice", 1.1)
    added = transform_target_encode(orders, model, ["o_orderstatus"], "_x", "enc_")
    replaced = transform_target_encode(added, model, ["o_orderstatus"])
    return rounded(replaced.drop("o_totalprice"), 3, "o_orderstatus", "enc_o_orderstatus_x")


@query(
    "e4_te_full",
    f"""WITH {FINISHED}, g AS (SELECT avg(finished) AS m FROM finished_orders)
        SELECT c_mktsegment, count(*) AS n_samples,
               round((sum(finished) + 2 * any_value(m)) / (count(*) + 2), 8) AS encoded
        FROM finished_orders, g GROUP BY 1""",
)
def _te_full(spark, d):
    model = fit_target_encoder(finished_orders(spark, d), ["c_mktsegment"], "finished", 2.0)
    return rounded(model["c_mktsegment"].table, 8, "encoded")


@query(
    "e5_te_transform_unknown",
    f"""WITH {FINISHED}, t AS (SELECT *, {kfold_sql('o_orderkey', 3)} AS fold FROM finished_orders),
        g AS (SELECT avg(finished) AS m FROM t WHERE fold <> 0),
        c AS (SELECT o_custkey, count(*) AS n, sum(finished) AS s FROM t WHERE fold <> 0 GROUP BY 1)
        SELECT o_orderkey, round(coalesce((s + 1.1 * m) / (n + 1.1), m), 8) AS enc_o_custkey
        FROM t LEFT JOIN c USING (o_custkey), g WHERE fold = 0""",
)
def _te_transform(spark, d):
    folds = kfold(finished_orders(spark, d), "o_orderkey", 3)
    model = fit_target_encoder(training_rows(folds, 0), ["o_custkey"], "finished", 1.1)
    coded = transform_target_encode(held_out_rows(folds, 0), model, ["o_custkey"], prefix="enc_")
    return rounded(coded.select("o_orderkey", "enc_o_custkey"), 8, "enc_o_custkey")


BETA = """SELECT *, prior * 3 + n * m AS a, (1 - prior) * 3 + n - n * m AS b FROM
  (SELECT * EXCLUDE (n, m), CASE WHEN n >= 1 THEN n ELSE gn END AS n, CASE WHEN n >= 1 THEN m ELSE gm END AS m FROM e)"""


@query(
    "e6_bte_binary",
    f"""WITH {FINISHED}, {_oof_sql('o_orderpriority', 'finished', 'finished_orders', 'o_orderkey')}
        SELECT o_orderkey, round(a / (a + b), 8) AS o_orderpriority_te,
               round(a * b / ((a + b) * (a + b) * (a + b + 1)), 12) AS o_orderpriority_te_var FROM ({BETA})""",
)
def _bte_binary(spark, d):
    coded, _ = bayesian_target_encode(
        finished_orders(spark, d), ["o_orderpriority"], "finished", "binary", "o_orderkey", prior_weight=3.0
    )
    coded = coded.select("o_orderkey", "o_orderpriority_te", "o_orderpriority_te_var")
    return rounded(rounded(coded, 8, "o_orderpriority_te"), 12, "o_orderpriority_te_var")


GAMMA = """SELECT *, (2 * prior + n * m) / (2 + n) AS mean,
  (1 + 0.5 * ss + 2 * n * pow(m - prior, 2) / (2 * (2 + n))) / ((1 + n / 2.0) * (2 + n)) AS var FROM
  (SELECT * EXCLUDE (n, m, ss), CASE WHEN n >= {leaf} THEN n ELSE gn END AS n,
          CASE WHEN n >= {leaf} THEN m ELSE gm END AS m, CASE WHEN n >= {leaf} THEN ss ELSE gss END AS ss FROM e)"""


@query(
    "e6_bte_continuous",
    f"""WITH {_oof_sql('o_orderpriority', 'o_totalprice', 'orders', 'o_orderkey')}
        SELECT o_orderkey, round(mean, 3) AS te, round(var, 1) AS te_var FROM ({GAMMA.format(leaf=1)})""",
)
def _bte_continuous(spark, d):
    coded, _ = bayesian_target_encode(
        table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "continuous", "o_orderkey",
        prior_weight=2.0,
    )
    return coded.select(
        "o_orderkey",
        F.round("o_orderpriority_te", 3).alias("te"),
        F.round("o_orderpriority_te_var", 1).alias("te_var"),
    )


@query(
    "e6_bte_composite_min_leaf",
    f"""WITH {_oof_sql('o_custkey, o_orderstatus', 'o_totalprice', 'orders', 'o_orderkey')}
        SELECT o_orderkey, round(mean, 3) AS te, round(var, 0) AS te_var FROM ({GAMMA.format(leaf=3)})""",
)
def _bte_composite(spark, d):
    coded, _ = bayesian_target_encode(
        table(spark, d, "orders"), [["o_custkey", "o_orderstatus"]], "o_totalprice", "continuous",
        "o_orderkey", prior_weight=2.0, min_samples_leaf=3,
    )
    return coded.select(
        "o_orderkey",
        F.round("o_custkey_o_orderstatus_te", 3).alias("te"),
        F.round("o_custkey_o_orderstatus_te_var", 0).alias("te_var"),
    )


@query(
    "a14_a16_bte_full_binary",
    f"""WITH {FINISHED}, g AS (SELECT avg(finished) AS p, count(*) AS gn, sum(finished) AS gs FROM finished_orders),
        c AS (SELECT o_custkey, count(*) AS n_samples, sum(finished) AS s FROM finished_orders GROUP BY 1),
        x AS (SELECT o_custkey, n_samples,
                CASE WHEN n_samples < 8 THEN p * 2 + gs ELSE p * 2 + s END AS a,
                CASE WHEN n_samples < 8 THEN (1 - p) * 2 + gn - gs ELSE (1 - p) * 2 + n_samples - s END AS b FROM c, g)
        SELECT o_custkey, n_samples, round(a / (a + b), 8) AS posterior_mean,
               round(a * b / ((a + b) * (a + b) * (a + b + 1)), 12) AS posterior_var,
               round(a, 6) AS alpha_post, round(b, 6) AS beta_post FROM x""",
)
def _bte_full(spark, d):
    model = fit_bayesian_encoder(
        finished_orders(spark, d), ["o_custkey"], "finished", "binary", 2.0, min_samples_leaf=8
    )
    found = rounded(model["o_custkey"].table, 6, "alpha_post", "beta_post")
    return rounded(rounded(found, 8, "posterior_mean"), 12, "posterior_var")


@query(
    "a15_bte_full_continuous",
    """WITH g AS (SELECT avg(l_quantity) AS p FROM lineitem),
       c AS (SELECT l_returnflag, l_linestatus, count(*) AS n_samples, avg(l_quantity) AS m,
                    var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
       x AS (SELECT *, 1 + n_samples / 2.0 AS a,
                    1 + 0.5 * ss + 4 * n_samples * pow(m - p, 2) / (2 * (4 + n_samples)) AS b FROM c, g)
       SELECT l_returnflag, l_linestatus, n_samples, round((4 * p + n_samples * m) / (4 + n_samples), 8) AS posterior_mean,
              round(b / (a * (4 + n_samples)), 8) AS posterior_var, round(a, 6) AS alpha_post,
              round(b, 2) AS beta_post FROM x""",
)
def _normal_full(spark, d):
    spec = ["l_returnflag", "l_linestatus"]
    model = fit_bayesian_encoder(
        table(spark, d, "lineitem"), [spec], "l_quantity", "continuous", 4.0
    )
    found = rounded(model["_".join(spec)].table, 8, "posterior_mean", "posterior_var")
    return rounded(rounded(found, 6, "alpha_post"), 2, "beta_post")


@query(
    "e7_bte_transform",
    f"""WITH t AS (SELECT *, {kfold_sql('o_orderkey', 3)} AS fold FROM orders),
        g AS (SELECT avg(o_totalprice) AS p FROM t WHERE fold <> 1),
        c AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM t WHERE fold <> 1 GROUP BY 1)
        SELECT o_orderkey, round(coalesce((2.1 * p + n * m) / (2.1 + n), p), 3) AS o_custkey_te
        FROM t LEFT JOIN c USING (o_custkey), g WHERE fold = 1""",
)
def _bte_transform(spark, d):
    folds = kfold(table(spark, d, "orders"), "o_orderkey", 3)
    model = fit_bayesian_encoder(training_rows(folds, 1), ["o_custkey"], "o_totalprice", "continuous", 2.1)
    coded = transform_bayesian_target_encode(held_out_rows(folds, 1), model, ["o_custkey"])
    return rounded(coded.select("o_orderkey", "o_custkey_te"), 3, "o_custkey_te")


def _past_sql(cat: str, y: str, prior: str = "avg(y) OVER ()") -> str:
    return f"""WITH t AS (SELECT event_id, ts, {cat}, ({y})::DOUBLE AS y FROM events),
      p AS (SELECT event_id, {prior} AS g, count(*) OVER w AS n, coalesce(sum(y) OVER w, 0) AS s FROM t
            WINDOW w AS (PARTITION BY {cat} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "w2_te_expanding_binary",
    f"""{_past_sql('event_type', 'value > 20')}
        SELECT event_id, round(CASE WHEN n < 1 THEN g ELSE (1.1 * g + s) / (1.1 + n) END, 8) AS te FROM p""",
)
def _expanding_binary(spark, d):
    events = table(spark, d, "events").withColumn("y", (F.col("value") > 20).cast("int"))
    coded, _ = time_series_target_encode(events, ["event_type"], "y", "ts", "event_id", prior_weight=1.1)
    return coded.select("event_id", F.round("event_type_te", 8).alias("te"))


@query(
    "w2_te_expanding_continuous",
    f"""{_past_sql('user_id', 'value')}
        SELECT event_id, round(CASE WHEN n < 4 THEN g ELSE (3.1 * g + s) / (3.1 + n) END, 6) AS te FROM p""",
)
def _expanding_continuous(spark, d):
    coded, _ = time_series_target_encode(
        table(spark, d, "events"), ["user_id"], "value", "ts", "event_id", "continuous", 3.1, min_samples=4
    )
    return coded.select("event_id", F.round("user_id_te", 6).alias("te"))


PAST_MEAN = "avg(y) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "w2_te_expanding_past_prior",
    f"""{_past_sql('event_type', 'value', PAST_MEAN)}
        SELECT event_id, round(CASE WHEN n < 1 THEN g ELSE (1.1 * g + s) / (1.1 + n) END, 6) AS te FROM p""",
)
def _expanding_past(spark, d):
    coded, _ = time_series_target_encode(
        table(spark, d, "events"), ["event_type"], "value", "ts", "event_id", "continuous", 1.1, prior="past"
    )
    return coded.select("event_id", F.round("event_type_te", 6).alias("te"))


@query(
    "e8_expanding_full_encoder",
    """WITH g AS (SELECT avg(value) AS p FROM events),
       c AS (SELECT event_type, count(*) AS n_samples, sum(value) AS s FROM events GROUP BY 1)
       SELECT event_type, n_samples, round((p + s) / (1 + n_samples), 6) AS posterior_mean FROM c, g""",
)
def _expanding_full(spark, d):
    _, model = time_series_target_encode(
        table(spark, d, "events"), ["event_type"], "value", "ts", "event_id", "continuous"
    )
    found = model["event_type"].table.select("event_type", "n_samples", "posterior_mean")
    return rounded(found, 6, "posterior_mean")


@query(
    "u4_recipe",
    f"""WITH {FINISHED}, {_oof_sql('c_mktsegment', 'finished', 'finished_orders', 'o_orderkey')}
        SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS log_price, fold,
               round(CASE WHEN n > 0 THEN (n * m + prior) / (n + 1) ELSE prior END, 8) AS segment_rate FROM e""",
)
def _recipe(spark, d):
    customer = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    target = lambda df: df.withColumn("finished", (F.col("o_orderstatus") == "F").cast("int"))
    made = compose(
        {"orders": table(spark, d, "orders"), "customer": customer},
        [
            {"id": "joined", "method": "join", "from": ["orders", "customer"], "options": {"on": "o_custkey"}},
            {"id": "unused", "method": "select_columns", "options": {"columns": ["c_name"]}},
            {"id": "target", "method": target, "from": "joined"},
            {"id": "logged", "method": "arithmetic",
             "options": {"operation": "log1p", "col_a": "o_totalprice", "output_col": "log_price"}},
            {"id": "folds", "method": "assign_folds", "options": {"strategy": "kfold", "keys": "o_orderkey"}},
            {"id": "coded", "method": "target_encode",
             "options": {"columns": ["c_mktsegment"], "target_col": "finished", "fold_col": "fold", "suffix": "_te"}},
        ],
    )
    rows = made.tables["coded"].select(
        "o_orderkey", "log_price", "fold", F.col("c_mktsegment_te").alias("segment_rate")
    )
    return rounded(rounded(rows, 6, "log_price"), 8, "segment_rate")
