"""W and X: ordering, weights, samples, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.catalog.registry import JUDGED, judged, query, rounded, shuffle_sql, table
from foldwise.operators.evaluate import error_samples
from foldwise.operators.sample import exp_weight, id_transitions, stratified_subsample
from foldwise.plans.ordering import running_totals, with_row_index

NEWEST = "row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1"


@query(
    "w1_exp_weight",
    f"SELECT event_id, round(pow(0.95::DOUBLE, {NEWEST}), 9) AS weight FROM events",
)
def _recent(spark, d):
    weighted = exp_weight(table(spark, d, "events"), "ts", "event_id", 0.95, "weight")
    return rounded(weighted.select("event_id", "weight"), 9, "weight")


@query(
    "w1_exp_weight_slow_decay",
    f"SELECT event_id, round(pow(0.99999::DOUBLE, {NEWEST}), 9) AS weight FROM events",
)
def _slow(spark, d):
    weighted = exp_weight(table(spark, d, "events"), "ts", "event_id", 0.99999, "weight")
    return rounded(weighted.select("event_id", "weight"), 9, "weight")


@query(
    "w3_error_samples",
    f"""WITH {JUDGED}, e AS (
          SELECT *, CAST(score >= 0.5 AS INTEGER) AS p, abs(score - quality) AS err FROM judged),
        s AS (SELECT *, CASE WHEN quality = 1 AND p = 1 THEN 'TP' WHEN quality = 0 AND p = 0 THEN 'TN'
                             WHEN quality = 0 AND p = 1 THEN 'FP' ELSE 'FN' END AS sample_type FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY sample_type ORDER BY
                CASE WHEN sample_type IN ('FP', 'FN') THEN -err ELSE err END, doc_id) AS k FROM s)
        SELECT doc_id, sample_type, CAST(k AS INTEGER) AS sample_rank, round(err, 8) AS error_magnitude
        FROM r WHERE k <= 10""",
)
def _samples(spark, d):
    found = error_samples(judged(spark, d), "quality", "score", ["doc_id"], 10)
    return rounded(
        found.select("doc_id", "sample_type", "sample_rank", "error_magnitude"), 8, "error_magnitude"
    )


@query(
    "w4_id_transitions",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
                  WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))
       SELECT l_orderkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS "order"
       FROM r""",
)
def _transitions(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return id_transitions(table(spark, d, "lineitem"), "l_orderkey", order)


@query(
    "w5_stratified_subsample",
    f"""SELECT o_orderkey, o_orderstatus FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {shuffle_sql('o_orderkey')}) AS r,
                 greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.1)) AS keep FROM orders)
        WHERE r <= keep""",
)
def _subsample(spark, d):
    kept = stratified_subsample(table(spark, d, "orders"), 0.1, "o_orderstatus", "o_orderkey")
    return kept.select("o_orderkey", "o_orderstatus")


@query(
    "w6_w7_sorted_head",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def _head(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query(
    "x1_row_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders",
)
def _index(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return with_row_index(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query(
    "x2_running_totals",
    """SELECT event_id, count(*) OVER w AS earlier, round(coalesce(sum(value) OVER w, 0), 4) AS total
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _totals(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    totals = {"earlier": F.lit(1).cast("long"), "total": F.col("value")}
    found = running_totals(events, ["event_type"], ["ts", "event_id"], totals)
    return rounded(found.select("event_id", "earlier", "total"), 4, "total")
