"""Splits and samples: exact sizes, group integrity, hot groups, repeatability."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from foldwise.operators import split
from foldwise.operators.sample import duplicated, exp_weight, id_transitions, stratified_subsample
from foldwise.operators.split import (
    assign_folds, group_kfold, held_out_rows, kfold, leave_one_group_out, stratified_group_kfold,
    stratified_kfold, time_held_out_rows, time_series, time_training_rows, training_rows,
)
from foldwise.plans import dealing
from tests.oracle import compare


@pytest.fixture(scope="module")
def df(spark):
    """Group 0 holds a third of all rows; class 'rare' has two rows."""
    rows = []
    for i in range(303):
        group = 0 if i % 3 == 0 else i % 17 + 1
        label = "rare" if i in (5, 250) else ("x" if i % 4 else "y")
        rows.append((i, group, label, i // 2))
    return spark.createDataFrame(rows, "id int, g int, label string, t int").repartition(4)


def sizes(table, *columns):
    return Counter(tuple(r[c] for c in columns) for r in table.collect())


@pytest.mark.parametrize("k", [2, 5, 7])
def test_kfold_sizes_differ_by_one(df, k):
    found = sizes(kfold(df, "id", k), "fold")
    assert sorted(found) == [(i,) for i in range(k)] and sum(found.values()) == 303
    assert max(found.values()) - min(found.values()) <= 1


def test_kfold_depends_on_seed_only(df):
    first = {r.id: r.fold for r in kfold(df, "id").collect()}
    assert first == {r.id: r.fold for r in kfold(df.repartition(9), "id").collect()}
    assert first != {r.id: r.fold for r in kfold(df, "id", seed=1).collect()}


def test_fold_sides(df):
    folds = kfold(df, "id", 3)
    for i in range(3):
        train, test = training_rows(folds, i).count(), held_out_rows(folds, i).count()
        assert train + test == 303 and test in (101,)


def test_hash_folds_need_no_pass(df):
    found = sizes(kfold(df, "id", 5, exact=False), "fold")
    assert len(found) == 5 and min(found.values()) > 30


def test_stratified_sizes(df):
    found = stratified_kfold(df, "id", "label", 5)
    for label in ("x", "y", "rare"):
        per_fold = sizes(found.where(F.col("label") == label), "fold")
        counts = [per_fold.get((i,), 0) for i in range(5)]
        assert max(counts) - min(counts) <= 1
    total = sizes(found, "fold")
    assert max(total.values()) - min(total.values()) <= 1


def test_stratified_with_null_class(df):
    found = stratified_kfold(df.withColumn("label", F.when(F.col("id") > 9, F.col("label"))), "id", "label", 5)
    assert found.where("fold IS NULL").count() == 0


def test_groups_stay_whole_and_the_hot_one_alone(df):
    found = group_kfold(df, "g", 3)
    folds = defaultdict(set)
    for r in found.collect():
        folds[r.g].add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    assert {g for g, f in folds.items() if f == folds[0]} == {0}
    total = sizes(found, "fold")
    assert max(total.values()) - min(total.values()) <= 20


def test_stratified_groups_stay_whole(df):
    folds = defaultdict(set)
    for r in stratified_group_kfold(df, "label", "g", 3).collect():
        folds[r.g].add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    assert set().union(*folds.values()) == {0, 1, 2}


@pytest.mark.parametrize("fan", [2, 4096])
def test_both_classes_differ_by_one_group_at_most(spark, monkeypatch, fan):
    monkeypatch.setattr(dealing, "FAN", fan)
    rng = random.Random(9)
    rows = [(g if g else None, int(rng.random() < rng.choice([0.1, 0.5, 0.97]))) for g in range(90) for _ in range(rng.randint(1, 40))]
    found = stratified_group_kfold(spark.createDataFrame(rows, "g int, y int"), "y", "g", 4).collect()
    loads, counts, folds = Counter((r.y, r.fold) for r in found), Counter((r.y, r.g) for r in found), defaultdict(set)
    for r in found:
        folds[r.g].add(r.fold)
    assert len(found) == len(rows) and all(len(f) == 1 for f in folds.values())
    for y in (0, 1):
        each = [loads[y, f] for f in range(4)]
        assert max(each) - min(each) <= max(n for (c, _), n in counts.items() if c == y)


def test_dominant_groups_leave_the_other_folds_even(spark):
    rng = random.Random(3)
    rows = [("hot", i % 3 == 0, "p") for i in range(4000)]
    rows += [(f"g{g}", rng.random() < 0.3, rng.choice("pqrst")) for g in range(400) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g string, y boolean, c string")
    for target in ("y", "c"):
        found = stratified_group_kfold(df, target, "g", 5).collect()
        assert {r.fold for r in found if r.g == "hot"} == {0}
        loads = Counter((r[target], r.fold) for r in found if r.fold)
        assert {r.g for r in found if r.fold == 0} == {"hot"}
        for value in {r[target] for r in found}:
            each = [loads[value, f] for f in range(1, 5)]
            assert max(each) - min(each) <= 9


def test_every_event_gets_the_fold_that_sql_deals(spark, tmp_path):
    """Rows, not totals; a user with a third of them, a NULL one, a NULL class and a last run of few groups."""
    rng = random.Random(5)
    rows = [(None if g == 7 else g, rng.choice(["a", "a", "b", "c", None])) for g in range(1, 44) for _ in range(rng.randint(1, 30))]
    rows += [(0, "a")] * 400
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = queries()["f5_stratified_group_kfold"](spark, str(tmp_path))
    assert compare(db, found, oracle_sql()["f5_stratified_group_kfold"]) == []
    assert found.count() == len(rows) and found.where("user_id = 0 AND fold = 0").count() == 400


def test_rare_classes_count_together(spark, monkeypatch):
    monkeypatch.setattr(split, "CLASSES", 2)
    df = spark.range(600).select((F.col("id") % 60).alias("g"), (F.col("id") * 7 % 13).alias("y"))
    found = stratified_group_kfold(df, "y", "g", 3).groupBy("fold").count().collect()
    assert {r["count"] for r in found} == {200}


def test_leave_one_group_out(df):
    found = {(r.g, r.fold) for r in leave_one_group_out(df, "g").collect()}
    assert found == {(g, i) for i, g in enumerate(sorted({g for g, _ in found}))}


def test_time_series_blocks(df):
    found = time_series(df, "t", "id", 5)
    size = 303 // 6
    rows = sorted((r.t, r.id, r.block) for r in found.collect())
    assert [b for _, _, b in rows] == [0] * (303 - 5 * size) + [b for b in range(1, 6) for _ in range(size)]
    for i in range(5):
        train, test = time_training_rows(found, i), time_held_out_rows(found, i)
        assert test.count() == size and train.count() == 303 - (5 - i) * size


def test_split_arguments(df):
    assert assign_folds(df).columns == df.columns
    assert "fold" in assign_folds(df, "kfold", keys="id", n_splits=2).columns
    for bad in (
        lambda: assign_folds(df, "bootstrap"),
        lambda: kfold(df, "id", 1),
        lambda: kfold(df.limit(3), "id", 5),
        lambda: group_kfold(df, "g", 50),
        lambda: time_series(df.limit(3), "t", "id", 5),
    ):
        with pytest.raises(ValueError):
            bad()


def test_subsample_is_exact_and_repeatable(df):
    found = stratified_subsample(df, 0.1, "label", "id")
    n = sizes(df, "label")
    assert sizes(found, "label") == {k: max(1, int(v * 0.1)) for k, v in n.items()}
    ids = sorted(r.id for r in found.collect())
    assert ids == sorted(r.id for r in stratified_subsample(df.repartition(3), 0.1, "label", "id").collect())
    assert ids != sorted(r.id for r in stratified_subsample(df, 0.1, "label", "id", seed=1).collect())
    assert stratified_subsample(df, 1.0, "label", "id") is df


def test_subsample_keeps_single_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, c string")
    assert stratified_subsample(df, 0.01, "c", "id").count() == 2


@pytest.mark.parametrize("decay", [0.5, 0.9999, 1.0])
def test_exp_weight(df, decay):
    rows = exp_weight(df, "t", "id", decay, "w").collect()
    newest_first = sorted(rows, key=lambda r: (r.t, r.id), reverse=True)
    assert [r.w for r in newest_first] == pytest.approx([decay**i for i in range(303)], rel=1e-12, abs=0)


@pytest.mark.parametrize("decay", [0.01, 0.95, 0.999])
def test_weights_equal_the_power_on_every_row(spark, decay):
    rows = exp_weight(spark.range(20_000).withColumn("t", -F.col("id")), "t", "id", decay, "w")
    wrong = rows.where(F.col("w") != F.pow(F.lit(decay), F.col("id"))).count()
    assert wrong == 0 and rows.count() == 20_000


@pytest.mark.parametrize("decay", [0.01, 0.95, 1.0])
def test_weights_of_repeated_keys_are_refused(spark, decay):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "id int, t int")
    with pytest.raises(ValueError):
        exp_weight(df, "t", "id", decay)
    null_key = spark.createDataFrame([(None, 5), (2, 7)], "id int, t int")
    assert {r.id: r["__weight__"] for r in exp_weight(null_key, "t", "id", 0.5).collect()} == {None: 0.5, 2: 1.0}


def test_duplicates_and_transitions(spark):
    rows = [(1, "a", 3), (2, "b", 1), (3, "a", 2), (4, None, 0), (5, None, 9), (6, "c", 5)]
    df = spark.createDataFrame(rows, "id int, k string, t int")
    assert sorted(r.id for r in duplicated(df, "k").collect()) == [1, 3, 4, 5]
    found = [(r.k, r.order) for r in id_transitions(df, "k", ["t", "id"]).orderBy("order").collect()]
    assert found == [(None, 0), ("a", 1), ("a", 2), (None, 3)]
    assert id_transitions(df, "id", ["t"]).count() == 0
