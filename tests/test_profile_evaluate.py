"""Profiles, scores, ensembles and trees."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwise.operators.ensemble import ensemble, output_tables
from foldwise.operators.evaluate import (
    accuracy, arg_max, binary_auc, cv_summary, error_samples, labels_out_of_range, macro_auc,
    readiness_report,
)
from foldwise.operators.learn import booster, cross_validate_trees, fold_scores, score_folds
from foldwise.operators.profile import (
    describe, describe_long, distributions, group_describe, group_stats, histograms, missing_matrix,
    missing_table, run_profile, table_profile, top_values, value_counts,
)
from foldwise.operators.split import kfold


@pytest.fixture(scope="module")
def parcels(spark):
    """Seven parcels; one was not weighed, one has no driver."""
    rows = [
        (10, "north", 2.0, "Kim"), (11, "south", 4.0, "Lee"), (12, "north", None, "Kim"), (13, "south", 6.0, "Moe"),
        (14, "north", 9.0, "Kim"), (15, "north", 5.0, None), (16, "south", 4.0, "Lee"),
    ]
    return spark.createDataFrame(rows, "parcel long, zone string, weight double, driver string")


def test_describe(parcels):
    found = {r["column"]: r for r in describe(parcels).collect()}
    weight, driver = found["weight"], found["driver"]
    assert (weight["count"], weight.null_count, weight.min, weight.max) == (6, 1, 2.0, 9.0)
    assert (weight.q25, weight.q50, weight.q75) == (4.0, 4.5, 5.75)
    assert weight.mean == 5.0 and weight.std == pytest.approx(math.sqrt(28 / 5))
    assert (driver["count"], driver.uniq, driver.top, driver.freq) == (6, 3, "Kim", 3)
    assert driver.mean is None and weight.top is None


def test_describe_long_takes_nearest_values(parcels):
    found = {r.statistic: r for r in describe_long(parcels).collect()}
    assert found["null_count"].weight == 1.0
    # (n - 1) * q is 1.25, 2.5, 3.75: places 1, 3, 4 of 2, 4, 4, 5, 6, 9.
    assert [found[s].weight for s in ("25%", "50%", "75%")] == [4.0, 5.0, 6.0]


def test_group_profiles(parcels):
    stats = {r.zone: r for r in group_stats(parcels, "zone").collect()}
    assert stats["south"].weight_mean == pytest.approx(14 / 3) and stats["north"]["count"] == 4
    assert "zone_mean" not in stats["north"]
    full = {(r.zone, r["column"]): r for r in group_describe(parcels, "zone").collect()}
    assert full["north", "weight"].null_count == 1 and full["north", "weight"].q50 == 5.0
    assert full["south", "driver"].uniq == 2


def test_missing_tables(parcels):
    found = {r["column"]: r for r in missing_table(parcels).collect()}
    assert found["driver"].missing_count == 1 and found["zone"].missing_pct == 0.0
    assert found["weight"].missing_pct == pytest.approx(100 / 7, abs=0.01)
    empty = missing_table(parcels.where("parcel < 0"))
    assert {r.missing_pct for r in empty.collect()} == {0.0}
    profile = {r["column"]: r for r in table_profile(parcels).collect()}
    assert (profile["weight"].n_rows, profile["weight"].n_columns, profile["weight"].dtype) == (7, 4, "double")


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(31)] + [(None, 7.0)], "x double, c double")
    found = histograms(df, ["x", "c"]).collect()
    x = {r.bin: r for r in found if r["column"] == "x"}
    assert len(x) == 30 and x[29]["count"] == 2 and x[0].bin_left == 0.0 and x[29].bin_right == 30.0
    c = {r.bin: r for r in found if r["column"] == "c"}
    assert c[15]["count"] == 32 and (c[0].bin_left, c[29].bin_right) == (6.5, 7.5)


def test_value_counts_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,)], "c string")
    assert [tuple(r) for r in value_counts(df, "c").collect()] == [(None, 2), ("b", 2), ("a", 1)]
    assert [tuple(r) for r in value_counts(df, "c", 1, keep_null=False).collect()] == [("b", 2)]


def test_missing_matrix(parcels):
    ordered = missing_matrix(parcels, "parcel", 7, ["parcel"], ["weight"])
    assert {r.bucket: r.null_fraction for r in ordered.collect()} == {i: float(i == 2) for i in range(7)}
    hashed = missing_matrix(parcels, "parcel", 1, columns=["weight"])
    assert hashed.first().null_fraction == pytest.approx(1 / 7)


def test_profile_steps(parcels):
    steps = {"missing_values": {}, "group_stats": {"group_by": "zone"}, "mine": {}}
    assert set(run_profile(parcels, steps, {"mine": lambda df: df})) == set(steps)
    with pytest.raises(ValueError):
        run_profile(parcels, {"mystery": {}})


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    rows = [(g, int(rng.random() < 0.4), rng.randrange(12) / 10) for g in (0, 1) for _ in range(150)]
    rows += [(2, 1, 0.5), (2, 1, 0.7)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    found = {r.g: r.auc for r in binary_auc(df, "y", "p", ["g"]).collect()}
    for g in (0, 1):
        assert found[g] == pytest.approx(brute_auc([r[1:] for r in rows if r[0] == g]))
    assert found[2] is None
    assert binary_auc(df, "y", "p").first().auc == pytest.approx(brute_auc([r[1:] for r in rows]))


def test_macro_auc_skips_degenerate_classes(spark):
    rows = [([1, 0, 1], [0.9, 0.1, 0.3]), ([0, 0, 1], [0.2, 0.4, 0.6]), ([1, 0, 1], [0.1, 0.2, 0.5])]
    df = spark.createDataFrame(rows, "y array<int>, p array<double>")
    assert macro_auc(df, "y", "p").first().macro_auc == 0.5
    assert macro_auc(df.where("y[0] = 1"), "y", "p").first().macro_auc == 0.0


def test_accuracy_and_summary(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9]), (0, [0.1, 0.9]), (0, [0.5, 0.5])], "y int, s array<double>")
    assert accuracy(df, "y", arg_max(F.col("s"))).first().accuracy == pytest.approx(2 / 3)
    scores = spark.createDataFrame([(0, 0.8), (1, 0.9), (2, 1.0)], "fold int, score double")
    row = cv_summary(scores).first()
    assert row.cv_mean == pytest.approx(0.9) and row.cv_std == pytest.approx(math.sqrt(0.02 / 3))


def test_error_samples_order(spark):
    rows = [(i, int(i % 2), (i * 37 % 100) / 100) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    found = error_samples(df, "y", "p", ["id"], 3).collect()
    assert [r.sample_type for r in found] == [t for t in ("TP", "TN", "FP", "FN") for _ in range(3)]
    for kind, sign in (("TP", 1), ("TN", 1), ("FP", -1), ("FN", -1)):
        errors = [sign * r.error_magnitude for r in found if r.sample_type == kind]
        assert errors == sorted(errors)


def test_label_range_and_readiness(spark):
    df = spark.createDataFrame([(0, "/a"), (7, "/b"), (-1, "/c"), (7, "/a")], "label int, path string")
    assert [r.label for r in labels_out_of_range(df, "label", 3).collect()] == [-1, 7]
    listing = spark.createDataFrame([("/a",)], "path string")
    found = readiness_report(df, ["label", "path", "gone"], "label", 3, path_col="path", listing=listing)
    messages = {r.field: r.message for r in found.collect()}
    assert messages == {
        "gone": "column gone does not exist",
        "label": "labels outside [0, 3): -1, 7 (rows: 3)",
        "path": "2/4 paths do not exist",
    }
    good = readiness_report(df.where("label = 0"), ["label"], "label", 3, path_col="path", listing=listing)
    assert good.count() == 0
    one_fold = readiness_report(df.withColumn("fold", F.lit(0)), [], fold_col="fold")
    assert one_fold.first().field == "fold"


def long_table(spark, *models):
    rows = [(i, f"m{j}", p) for j, m in enumerate(models) for i, p in enumerate(m)]
    return spark.createDataFrame(rows, "id int, model string, prediction double")


def merged(df):
    return [r.prediction for r in df.orderBy("id").collect()]


def test_ensembles(spark):
    two = long_table(spark, (0.2, 0.4, 0.6), (0.4, 0.6, 0.8))
    assert merged(ensemble(two, ["id"])) == pytest.approx([0.3, 0.5, 0.7])
    ends = long_table(spark, (1.0, 0.0), (0.0, 1.0))
    weighted = ensemble(ends, ["id"], "weighted_mean", weights={"m0": 3, "m1": 1})
    assert merged(weighted) == pytest.approx([0.75, 0.25])
    with pytest.raises(ValueError):
        ensemble(ends, ["id"], "weighted_mean", weights={"m0": 3})
    with pytest.raises(ValueError):
        ensemble(ends, ["id"], "median")
    ranks = long_table(spark, (0.1, 0.5, 0.5, 0.9), (100.0, 1.0, 2.0, 3.0))
    assert merged(ensemble(ranks, ["id"], "rank_average")) == pytest.approx([0.5, 0.25, 5 / 12, 5 / 6])
    assert merged(ensemble(long_table(spark, (0.4,)), ["id"], "rank_average")) == [0.0]
    mine = {"first": lambda p, keys: p.where("model = 'm0'")}
    assert ensemble(two, ["id"], "first", mine).count() == 3


def test_output_tables(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.4)], "id int, prediction double")
    assert set(output_tables(df, "id", "y")) == {"submission"}
    tables = output_tables(df, "id", "y", 0.5)
    assert [tuple(r) for r in tables["submission"].collect()] == [(1, 1), (2, 0)]
    assert [tuple(r) for r in tables["submission_proba"].collect()] == [(1, 0.5), (2, 0.4)]


def test_cross_validated_trees(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        x, c = rng.random(), rng.choice(["a", "b", "c"])
        y = int(x + (c == "a") * 0.3 + rng.gauss(0, 0.15) > 0.6)
        rows.append((i, x, c, rng.random(), y, 1.0 + y))
    df = spark.createDataFrame(rows, "id int, x double, c string, noise double, y int, w double")
    folds = kfold(df, "id", 3)
    result = cross_validate_trees(
        folds, ["x", "c", "noise"], "y", 3, categorical=["c", "gone"], weight_col="w",
        params={"maxIter": 5, "maxDepth": 3},
    )
    assert sorted(r.id for r in result.oof.collect()) == list(range(240))
    assert binary_auc(result.oof, "y", "predicted_proba").first().auc > 0.8
    scores = fold_scores(result, "y").collect()
    assert len(scores) == 3 and all(s.train_score > 0.8 and s.valid_score > 0.7 for s in scores)
    gains = {(r.fold, r.feature): r.importance for r in result.importance.collect()}
    assert len(gains) == 9 and all(gains[(f, "x")] > gains[(f, "noise")] for f in range(3))
    averaged = score_folds(result.models, df, ["id"])
    assert averaged.count() == 240 and averaged.where("prediction BETWEEN 0 AND 1").count() == 240
    with pytest.raises(ValueError):
        score_folds({}, df, ["id"])
    assert booster("y").getLabelCol() == "y"


def test_trees_take_many_categories_and_score_in_one_pass(spark):
    rows = spark.range(3000).selectExpr("id", "concat('k', id % 1000) AS k", "cast(id % 1000 < 500 AS int) AS y")
    folds = kfold(rows, "id", 2)
    result = cross_validate_trees(folds, ["k"], "y", 2, categorical=["k"], params={"maxIter": 1, "maxDepth": 1})
    assert all(s.valid_score > 0.8 for s in fold_scores(result, "y").collect())
    text = score_folds(result.models, rows, ["id"])._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert text.count("Range (") == 1
    unseen = spark.createDataFrame([(1, "new"), (2, None)], "id long, k string")
    assert score_folds(result.models, unseen, ["id"]).where("prediction BETWEEN 0 AND 1").count() == 2


def test_gaps_are_no_scores(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, None), (2, nan, 0.9), (3, 1.0, 0.2), (4, 0.0, nan)], "id int, y double, p double")
    assert [r.id for r in error_samples(df, "y", "p", ["id"], 1).collect()] == [3]
    both = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (nan, 0.0), (1.0, nan)], "y double, p double")
    assert binary_auc(both, "y", "p").first().auc == 1.0
    long = spark.createDataFrame([(1, "a", 0.8), (1, "b", None), (2, "a", 0.4), (2, "b", nan)], "id int, model string, prediction double")
    got = ensemble(long, ["id"], "weighted_mean", weights={"a": 1.0, "b": 1.0}).orderBy("id").collect()
    assert [r.prediction for r in got] == [0.8, 0.4]
    ranks = ensemble(long, ["id"], "rank_average").orderBy("id").collect()
    assert [r.prediction for r in ranks] == [1.0, 0.0]


def test_all_columns_unless_limited(spark):
    df = spark.range(3).selectExpr("id", *[f"id AS c{i}" for i in range(24)])
    names = lambda table: {r[0] for r in table.select("column").distinct().collect()}
    assert len(names(distributions(df))) == 25 and len(names(distributions(df, 4))) == 4


def test_commonest_values_of_long_texts(spark):
    """Ties between short and long texts, equal beginnings, all texts once, and NULLs."""
    long = ["y" * 40 + c for c in "cab"]
    rows = (
        [(1, t) for t in ["x" * 16, "x" * 17, *long]]  # all once: the least text
        + [(2, t) for t in [long[0], long[1], long[2]] * 2 + ["zz", "zz", "a"]]  # four twice
        + [(3, t) for t in ["y" * 16, "y" * 16, long[1], long[1]]]  # a short one that is the beginning
        + [(4, None), (None, long[0]), (None, "é" * 20), (None, "é" * 20)]
    )
    found = {r.g: (r.uniq, r.top, r.freq) for r in top_values(spark.createDataFrame(rows, "g int, t string"), ["t"], ["g"]).collect()}
    assert found == {
        1: (5, "x" * 16, 1), 2: (5, long[1], 2), 3: (2, "y" * 16, 2), None: (2, "é" * 20, 2),
    }
    whole = top_values(spark.createDataFrame(rows, "g int, t string"), ["t"]).first()
    texts = Counter(t for _, t in rows if t)
    best = min(texts, key=lambda t: (-texts[t], t.encode()))
    assert (whole.uniq, whole.top, whole.freq) == (len(texts), best, texts[best])


def test_rank_areas_count_ties_before_they_rank(spark):
    """No window over a side's rows: what is ranked are its distinct scores."""
    from foldwise.catalog.evaluate_queries import rank_areas

    rows = [(i % 2, i % 3 == 0, int(i * 7 % 5 > 1), (i * 13 % 4) / 4) for i in range(400)]
    scored = spark.createDataFrame(rows, "fold int, held_out boolean, y int, p double")
    found = rank_areas(scored)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "windowspecdefinition" in line and "__part" not in line]
    for r in found.collect():
        for held_out, area in ((False, r.train), (True, r.valid)):
            own = [(y, p) for f, h, y, p in rows if f == r.fold and h == held_out]
            wins = [(a > b) + (a == b) / 2 for x, a in own if x for y, b in own if not y]
            assert abs(area - sum(wins) / len(wins)) < 1e-12


def test_quantiles_of_small_and_large_groups(spark, monkeypatch):
    """Small groups are sorted as arrays, large ones by brackets; NULL, NaN and a NULL group included."""
    from foldwise.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL_GROUP", 50)
    rows = [(None if i % 11 == 0 else "big" if i % 2 else f"g{i % 7}", float(i * 37 % 101), None if i % 5 == 0 else float("nan") if i % 13 == 0 else float(i % 17))
            for i in range(500)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for way in ("linear", "nearest"):
        found = {(r.g, r.column): (r.low, r.mid) for r in quantiles.exact_quantiles(df, ["x", "y"], {"low": 0.1, "mid": 0.5}, ["g"], way).collect()}
        for g in {r[0] for r in rows}:
            for at, name in ((1, "x"), (2, "y")):
                values = sorted(r[at] for r in rows if r[0] == g and r[at] is not None and r[at] == r[at])
                if not values:
                    assert (g, name) not in found
                    continue
                for q, v in zip((0.1, 0.5), found[g, name]):
                    place = (len(values) - 1) * q
                    low, high = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
                    exact = values[int(place + 0.5)] if way == "nearest" else low + (high - low) * (place - int(place))
                    assert abs(v - exact) < 1e-9
