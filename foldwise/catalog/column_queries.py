"""P, J and E1-E2: projections, predicates, joins, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.catalog.registry import (
    FINISHED, JUDGED, LABELLED, finished_orders, judged, kfold_sql, labelled, query, rounded, table,
)
from foldwise.functions.numeric import arithmetic
from foldwise.operators.columns import (
    binarise, drop_nulls, format_column, null_indicators, path_exists, plot_columns,
    sample_weight, select_columns, with_errors,
)
from foldwise.operators.impute import apply_imputer, fill_na, fit_imputer
from foldwise.operators.joins import join_tables, members, stack_predictions
from foldwise.operators.learn import categorical_codes
from foldwise.operators.sample import duplicated
from foldwise.operators.split import kfold, held_out_rows, training_rows

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = ", ".join(LINE)


@query("p1_select_columns", "SELECT p_type, p_partkey, p_size FROM part")
def _select(spark, d):
    return select_columns(table(spark, d, "part"), ["p_type", "p_partkey", "p_size"])


def _arithmetic(name, operation, col_a, col_b, sql):
    @query(name, f"SELECT {LINE_SQL}, round({sql}, 4) AS result FROM lineitem")
    def run(spark, d):
        lines = arithmetic(table(spark, d, "lineitem"), operation, col_a, "result", col_b)
        return rounded(lines.select(*LINE, "result"), 4, "result")


_arithmetic("p2_arith_add", "add", "l_discount", "l_tax", "l_discount + l_tax")
_arithmetic(
    "p3_arith_subtract", "subtract", "l_extendedprice", "l_quantity", "l_extendedprice - l_quantity"
)
_arithmetic(
    "p4_arith_multiply", "multiply", "l_extendedprice", "l_discount", "l_extendedprice * l_discount"
)
_arithmetic("p6_arith_log1p", "log1p", "l_extendedprice", None, "ln(l_extendedprice + 1.0)")


@query(
    "p5_arith_divide",
    f"""SELECT {LINE_SQL}, isinf(q) AS infinite, CASE WHEN isinf(q) THEN NULL ELSE round(q, 4) END AS result
        FROM (SELECT *, l_extendedprice / l_discount AS q FROM lineitem)""",
)
def _divide(spark, d):
    lines = arithmetic(table(spark, d, "lineitem"), "divide", "l_extendedprice", "q", "l_discount")
    infinite = F.col("q") == float("inf")
    return lines.select(
        *LINE, infinite.alias("infinite"), F.when(~infinite, F.round("q", 4)).alias("result")
    )


@query(
    "p8_format_column",
    "SELECT p_partkey, 'parts/' || p_partkey || '/' || p_partkey || '.tif' AS path FROM part",
)
def _format(spark, d):
    parts = format_column(
        table(spark, d, "part"), "parts/{p_partkey}/{p_partkey}.tif", "p_partkey", "path"
    )
    return parts.select("p_partkey", "path")


@query(
    "p8_format_null",
    f"SELECT doc_id, 'q=' || coalesce(CAST(quality AS VARCHAR), 'None') AS tag FROM {LABELLED}",
)
def _format_null(spark, d):
    return format_column(labelled(spark, d), "q={quality}", "quality", "tag").select("doc_id", "tag")


@query(
    "p9_composite_key",
    """SELECT o_orderpriority || '_' || o_orderstatus AS name, count(*) AS n
       FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def _composite(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus")
    name = F.concat_ws("_", "o_orderpriority", "o_orderstatus")
    return counts.agg(F.count(F.lit(1)).alias("n")).select(name.alias("name"), "n")


@query(
    "p11_null_indicator",
    f"""SELECT doc_id, CAST(quality IS NULL AS INTEGER) AS quality_is_null,
               CAST(lang IS NULL AS INTEGER) AS lang_is_null FROM {LABELLED}""",
)
def _null_indicator(spark, d):
    flagged = null_indicators(labelled(spark, d), ["quality", "lang"])
    return flagged.select("doc_id", "quality_is_null", "lang_is_null")


@query("p12_drop_nulls", f"SELECT doc_id, toxic FROM {LABELLED} WHERE toxic IS NOT NULL")
def _drop_nulls(spark, d):
    return drop_nulls(labelled(spark, d), "toxic").select("doc_id", "toxic")


@query("p13_plot_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def _plot_columns(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(*plot_columns(orders, 4))


@query(
    "p14_binarise",
    f"WITH {JUDGED} SELECT doc_id, CAST(score >= 0.6 AS INTEGER) AS label FROM judged",
)
def _binarise(spark, d):
    return judged(spark, d).select("doc_id", binarise(F.col("score"), 0.6).alias("label"))


@query(
    "p15_p16_errors",
    f"""WITH {JUDGED}, e AS (
          SELECT *, CAST(score >= 0.5 AS INTEGER) AS predicted_label FROM judged)
        SELECT doc_id, predicted_label, CAST(predicted_label = quality AS INTEGER) AS is_correct,
               round(abs(score - quality), 8) AS error_magnitude,
               CASE WHEN quality = 1 AND predicted_label = 1 THEN 'TP'
                    WHEN quality = 0 AND predicted_label = 0 THEN 'TN'
                    WHEN quality = 0 AND predicted_label = 1 THEN 'FP' ELSE 'FN' END AS sample_type
        FROM e""",
)
def _errors(spark, d):
    found = with_errors(judged(spark, d), "quality", "score").select(
        "doc_id", "predicted_label", "is_correct", "error_magnitude", "sample_type"
    )
    return rounded(found, 8, "error_magnitude")


@query(
    "p17_sample_weight",
    f"""WITH {FINISHED}
        SELECT o_orderkey, CASE finished WHEN 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS by_class,
               c_acctbal AS explicit
        FROM finished_orders""",
)
def _weights(spark, d):
    rows = finished_orders(spark, d)
    rows = sample_weight(rows, "finished", class_weight={1: 3.0}, output_col="by_class")
    rows = sample_weight(rows, "finished", "c_acctbal", {1: 3.0}, output_col="explicit")
    return rows.select("o_orderkey", "by_class", "explicit")


@query(
    "p18_categorical_codes",
    """WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code
                  FROM orders GROUP BY o_orderpriority)
       SELECT o_orderkey, CAST(code AS DOUBLE) AS code FROM orders JOIN c USING (o_orderpriority)""",
)
def _codes(spark, d):
    coded = categorical_codes(table(spark, d, "orders"), ["o_orderpriority", "absent"])
    return coded.select("o_orderkey", F.col("o_orderpriority__index").alias("code"))


@query(
    "p18_codes_of_many_categories",
    """WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS code
                  FROM orders GROUP BY o_custkey)
       SELECT o_orderkey, CAST(code AS DOUBLE) AS code FROM orders JOIN c USING (o_custkey)""",
)
def _codes_of_customers(spark, d):
    coded = categorical_codes(table(spark, d, "orders"), ["o_custkey"])
    return coded.select("o_orderkey", F.col("o_custkey__index").alias("code"))


@query(
    "p19_path_exists",
    f"SELECT doc_id, toxic IS NOT NULL AS known FROM {LABELLED}",
)
def _path_exists(spark, d):
    path = F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt"))
    listing = table(spark, d, "labels").select(path.alias("path"))
    rows = table(spark, d, "documents").select("doc_id", path.alias("doc_path"))
    return path_exists(rows, "doc_path", listing, "known").select("doc_id", "known")


@query(
    "p20_duplicated",
    f"""SELECT {LINE_SQL} FROM lineitem
        WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
)
def _duplicated(spark, d):
    return duplicated(table(spark, d, "lineitem"), "l_orderkey").select(*LINE)


def _tables(spark, d):
    """Orders by customer, customers, suppliers of the same numbers, and events by user."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.lit("o").alias("tag"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", F.lit("c").alias("tag"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return orders, customer, supplier, users


TABLES = """o AS (SELECT o_custkey AS k, o_orderkey, 'o' AS tag FROM orders),
  c AS (SELECT c_custkey AS k, c_name, 'c' AS tag_right FROM customer),
  s AS (SELECT s_suppkey AS k, s_name FROM supplier),
  u AS (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1)"""


def _multi_join(how, joins):
    @query(f"j1_join_{how}", f"WITH {TABLES} SELECT k, o_orderkey, tag, c_name, tag_right, n_events FROM {joins}")
    def run(spark, d):
        orders, customer, _, users = _tables(spark, d)
        return join_tables([orders, customer, users], "k", how)


_multi_join("left", "o LEFT JOIN c USING (k) LEFT JOIN u USING (k)")
_multi_join("inner", "o JOIN c USING (k) JOIN u USING (k)")
_multi_join("right", "o RIGHT JOIN c USING (k) RIGHT JOIN u USING (k)")


@query(
    "j1_join_full",
    f"""WITH {TABLES} SELECT o.k, o_orderkey, tag, s.k AS k_right, s_name, n_events
        FROM o FULL JOIN (s LEFT JOIN u ON s.k = u.k) ON o.k = s.k""",
)
def _full(spark, d):
    orders, _, supplier, users = _tables(spark, d)
    return join_tables([orders, join_tables([supplier, users], "k", "left")], "k", "full")


@query(
    "j1_join_semi",
    f"WITH {TABLES} SELECT * FROM o WHERE k IN (SELECT k FROM s) AND k IN (SELECT k FROM u)",
)
def _semi(spark, d):
    orders, _, supplier, users = _tables(spark, d)
    return join_tables([orders, supplier, users], "k", "semi")


@query(
    "j1_join_anti",
    f"WITH {TABLES} SELECT * FROM o WHERE k NOT IN (SELECT k FROM s) AND k NOT IN (SELECT k FROM u)",
)
def _anti(spark, d):
    orders, _, supplier, users = _tables(spark, d)
    return join_tables([orders, supplier, users], "k", "anti")


@query(
    "j4_members",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)",
)
def _members(spark, d):
    users = table(spark, d, "events").select("user_id")
    return members(table(spark, d, "orders"), "o_custkey", users).select("o_orderkey")


@query(
    "j5_fold_rows",
    f"""WITH t AS (SELECT *, {kfold_sql('o_orderkey')} AS fold FROM orders)
        SELECT CASE WHEN fold = 3 THEN 'test' ELSE 'train' END AS side, count(*) AS n,
               round(sum(o_totalprice), 2) AS price FROM t GROUP BY 1""",
)
def _fold_rows(spark, d):
    folds = kfold(table(spark, d, "orders"), "o_orderkey")

    def side(rows, name):
        return rows.agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")
        ).select(F.lit(name).alias("side"), "n", "price")

    return side(training_rows(folds, 3), "train").unionByName(side(held_out_rows(folds, 3), "test"))


@query(
    "j6_stack_predictions",
    """SELECT o_orderkey, 'price' AS model, o_totalprice AS prediction FROM orders
       UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE) FROM orders""",
)
def _stack(spark, d):
    orders = table(spark, d, "orders")
    models = {
        "price": orders.select("o_orderkey", F.col("o_totalprice").alias("p")),
        "customer": orders.select("o_orderkey", F.col("o_custkey").alias("p")),
    }
    return stack_predictions(models, "o_orderkey", "p")


GAPS = "(SELECT * REPLACE (nullif(l_quantity, 1.0) AS l_quantity, nullif(l_tax, 0.0) AS l_tax) FROM lineitem)"


def _gaps(spark, d):
    """Line items with some quantities and taxes missing."""
    return table(spark, d, "lineitem").withColumns(
        {
            "l_quantity": F.expr("nullif(l_quantity, 1.0D)"),
            "l_tax": F.expr("nullif(l_tax, 0.0D)"),
        }
    )


@query(
    "a11_imputer_model",
    f"SELECT median(l_quantity) AS l_quantity, round(median(l_tax), 8) AS l_tax FROM {GAPS}",
)
def _imputer(spark, d):
    model = fit_imputer(_gaps(spark, d), ["l_quantity", "l_tax"], "median")
    return rounded(model, 8, "l_tax")


def _fill(strategy, sql):
    @query(
        f"e1_fill_{strategy}",
        f"""WITH g AS (SELECT * FROM {GAPS})
            SELECT {LINE_SQL}, round(coalesce(l_quantity, {sql.format('l_quantity')}), 6) AS l_quantity,
                   round(coalesce(l_tax, {sql.format('l_tax')}), 6) AS l_tax FROM g""",
    )
    def run(spark, d):
        filled, _ = fill_na(_gaps(spark, d), ["l_quantity", "l_tax"], strategy, -999.0)
        return rounded(filled.select(*LINE, "l_quantity", "l_tax"), 6, "l_quantity", "l_tax")


_fill("median", "(SELECT median({}) FROM g)")
_fill("mean", "(SELECT avg({}) FROM g)")
_fill("constant", "CAST(-999.0 AS DOUBLE)")


@query(
    "e2_fill_train_to_test",
    f"""WITH g AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '42', l_orderkey)), 1, 8) AS BIGINT) % 4 AS fold FROM {GAPS})
        SELECT {LINE_SQL}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM g WHERE fold <> 0)), 6) AS l_quantity
        FROM g WHERE fold = 0""",
)
def _train_to_test(spark, d):
    folds = kfold(_gaps(spark, d), "l_orderkey", 4, exact=False)
    model = fit_imputer(training_rows(folds, 0), ["l_quantity"], "mean")
    filled = apply_imputer(held_out_rows(folds, 0), model, ["l_quantity"])
    return rounded(filled.select(*LINE, "l_quantity"), 6, "l_quantity")
