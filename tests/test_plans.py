"""Shapes of the physical plans that matter at scale."""

import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from foldwise.operators import profile, sample
from foldwise.plans import ordering
from foldwise.operators.columns import select_columns
from foldwise.operators.encode import target_encode, time_series_target_encode
from foldwise.operators.evaluate import error_samples
from foldwise.operators.impute import apply_imputer, fit_imputer
from foldwise.operators.quantiles import value_counts_long
from foldwise.operators.sample import exp_weight, stratified_subsample
from foldwise.operators.split import kfold, time_series
from foldwise.plans.brackets import group_brackets
from foldwise.plans.ordering import running_totals
from foldwise.plans.small import attach
from foldwise.session import cut_lineage
from foldwise.sources.readers import latest_run
from foldwise.sources.writers import read_fold, write_folds


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def shuffles(text):
    """Exchanges that move rows (broadcasts of small tables do not count)."""
    return len(re.findall(r"^[ :+\-*]*Exchange \(\d+\)", text, re.MULTILINE))


def test_shuffles_are_seen(tables):
    assert shuffles(plan(tables("orders").groupBy("o_custkey").count())) == 1


def test_kfold_is_a_projection(tables):
    text = plan(kfold(tables("orders"), "o_orderkey"))
    assert shuffles(text) == 0 and "Join" not in text


def test_time_split_moves_no_rows(tables):
    assert shuffles(plan(time_series(tables("events"), "ts", "event_id"))) == 0


def test_subsample_moves_no_whole_rows(tables):
    text = plan(stratified_subsample(tables("orders"), 0.1, "o_orderstatus", "o_orderkey"))
    assert shuffles(text) == 0 and "BroadcastHashJoin" in text


def test_imputation_is_a_projection(tables):
    lines = tables("lineitem")
    text = plan(apply_imputer(lines, fit_imputer(lines, ["l_tax"], "mean"), ["l_tax"]))
    assert "Join" not in text.split("Subqueries")[0]


def test_encoding_joins_rows_by_broadcast(tables):
    orders = tables("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    coded, _ = target_encode(orders, ["o_orderpriority"], "y", "o_orderkey", suffix="_te")
    text = plan(coded.select("o_orderkey", "o_orderpriority_te"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # The rows themselves are scanned once, and only the needed columns.
    scans = re.findall(r"ReadSchema: (.*)", text)
    assert scans == ["struct<o_orderkey:bigint,o_orderpriority:string>"]


def test_recency_weights_order_times_and_keys_only(spark, tables):
    df = spark.createDataFrame([(1, 10, "text"), (2, 11, "more")], "id int, t int, wide string")
    kept = []
    import foldwise.plans.ordering as ordering

    cut, ordering.cut_lineage = ordering.cut_lineage, lambda rows: kept.append(rows.columns) or cut(rows)
    try:
        exp_weight(df, "t", "id")
    finally:
        ordering.cut_lineage = cut
    assert len(kept) == 1 and "wide" not in kept[0]


def test_error_samples_limit_before_the_shuffle(tables):
    rows = tables("events").select("event_id", (F.col("value") > 20).cast("int").alias("y"), (F.col("value") / 100).alias("p"))
    text = plan(error_samples(rows, "y", "p", ["event_id"], 5))
    assert text.count("WindowGroupLimit") >= 2


def test_no_window_over_all_rows(tables):
    totals = running_totals(tables("events"), [], ["ts", "event_id"], {"s": F.col("value")})
    windows = re.findall(r"Arguments: \[sum\(__v_s.*", plan(totals))
    per_row = [w for w in windows if "__pos" in w]
    assert per_row and all(re.search(r"\[__part#", w) for w in per_row)


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(select_columns(tables("lineitem"), ["l_orderkey", "l_tax"]).where("l_tax > 0.05"))
    assert "GreaterThan(l_tax,0.05)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in text


def test_folds_and_runs_prune_partitions(spark, tmp_path):
    folds = kfold(spark.range(50), "id", 5)
    path = write_folds(folds, str(tmp_path), "out", ["id"])
    text = plan(read_fold(spark, path, 2, "test"))
    assert re.search(r"PartitionFilters: \[.*fold.* = 2", text)
    spark.range(3).withColumn("run_ts", F.lit("r1")).write.partitionBy("run_ts").parquet(f"{tmp_path}/runs")
    latest = plan(latest_run(spark.read.parquet(f"{tmp_path}/runs")))
    assert re.search(r"PartitionFilters: \[.*run_ts.*[Ss]ubquery", latest)


@pytest.mark.parametrize("name", ["e3_te_oof", "w2_te_expanding_binary", "f4_group_kfold", "l6_ensemble_rank"])
def test_no_cartesian_products(spark, name):
    from __spark_entry__ import queries

    text = plan(queries()[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_recency_weights_move_times_and_keys_only(tables):
    """Old rows get 0.0 in place; the few others their weight by a broadcast."""
    events = tables("events").withColumn("ts", F.col("ts"))
    wide = reduce(lambda a, b: a.unionByName(b), [events.withColumn("event_id", F.col("event_id") + i * 1_000_000) for i in range(3)])
    found = exp_weight(wide, "ts", "event_id", 0.5, "w")
    text = plan(found)
    assert shuffles(text) == 0 and "BroadcastHashJoin" in text
    aged = found.select("event_id", "ts", "w").collect()
    newest = sorted(aged, key=lambda r: (r.ts, r.event_id), reverse=True)
    assert [r.w for r in newest] == [0.5**i for i in range(len(newest))]


def test_recency_weights_without_a_broadcast(tables, monkeypatch):
    monkeypatch.setattr(sample, "BROADCAST_BYTES", 0)
    found = exp_weight(tables("events"), "ts", "event_id", 0.2, "w")
    newest = sorted(found.collect(), key=lambda r: (r.ts, r.event_id), reverse=True)
    assert [r.w for r in newest] == pytest.approx([0.2**i for i in range(len(newest))], rel=1e-12)
    # What has no weight is not shuffled: the union's other branch is a filter on the scan.
    assert "Union" in plan(found)


def test_group_quantiles_shuffle_few_values(spark):
    """Values far from the quantiles are merged before the exchange."""
    rows = spark.range(0, 60_000, 1, 4).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 60_013).alias("x"))
    columns = {"b": F.col("x")}
    ends = group_brackets(rows, columns, [0.25, 0.5, 0.75], ["g"])
    located = attach(rows, ends, ["g"], ["b"])
    counts = value_counts_long(located, ["x"], ["g"], {"x": "b"})
    assert 0 < counts.count() < 600 and counts.agg(F.sum("n")).first()[0] == 60_000


def test_long_texts_are_counted_without_moving_them(tables, monkeypatch):
    seen = []
    monkeypatch.setattr(profile, "cut_lineage", lambda df: seen.append(plan(df)) or cut_lineage(df))
    profile.top_values(tables("documents"), ["text", "lang"])
    exchanged = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", seen[0])
    assert exchanged and all("value" not in c and "digest" in c for c in exchanged)


def test_categories_share_one_time_layout(tables, monkeypatch):
    """Further category columns cost an aggregate and a window, no range sort or checkpoint."""
    written = []
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: written.append(plan(df, "simple")) or cut_lineage(df))
    rows = tables("events").withColumn("y", (F.col("value") > 50).cast("int"))
    categories = ["event_type", "user_id", ["event_type", "user_id"]]
    coded, _ = time_series_target_encode(rows, categories, "y", "ts", "event_id", prior="past")
    assert len(written) == 1 and written[0].count("rangepartitioning") == 1
    text = plan(coded, "simple")
    assert "rangepartitioning" not in text
