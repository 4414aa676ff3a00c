"""Target encodings: literals, leak tests and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators.encode import (
    bayesian_target_encode, fit_bayesian_encoder, fit_target_encoder, target_encode,
    time_series_target_encode, transform_bayesian_target_encode, transform_target_encode,
)


def by_id(df, *names):
    return {r.id: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "red", 0), (2, "red", 0), (3, "red", 1), (4, "blue", 1), (5, "blue", 1), (6, "blue", 0)]
    return spark.createDataFrame(rows, "id int, team string, won long")


def table_of(encoders, name, *columns):
    return {r[name]: tuple(r[c] for c in columns) for r in encoders[name].table.collect()}


def test_beta_binomial_literals(people):
    found = table_of(fit_bayesian_encoder(people, ["team"], "won", "binary", 2.0), "team", "posterior_mean", "n_samples")
    # Means of 1/3 and 2/3 pulled to 1/2 by a prior of weight 2.
    assert found == {"red": (pytest.approx(0.4), 3), "blue": (pytest.approx(0.6), 3)}


def test_normal_gamma_literals(spark):
    rows = [("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 10.0), ("B", 20.0), ("B", 15.0)]
    df = spark.createDataFrame(rows, "Cat string, Value double")
    encoders = fit_bayesian_encoder(df, ["Cat"], "Value", "continuous", 2.0)
    found = table_of(encoders, "Cat", "posterior_mean", "posterior_var", "alpha_post", "beta_post")
    # mean 8.5; beta = 1 + SS/2 + 2*3*(x - 8.5)^2 / (2*5); var = beta / (2.5 * 5)
    assert found["A"] == tuple(map(pytest.approx, (4.6, 27.35 / 12.5, 2.5, 27.35)))
    assert found["B"] == tuple(map(pytest.approx, (12.4, 51.35 / 12.5, 2.5, 51.35)))


def test_min_samples_leaf_takes_prior_but_keeps_count(spark):
    rows = [("A", 1.0)] * 5 + [("B", 0.0)]
    df = spark.createDataFrame(rows, "c string, y double")
    encoder = fit_bayesian_encoder(df, ["c"], "y", "binary", 1.0, min_samples_leaf=2)["c"]
    found = {r.c: (r.posterior_mean, r.n_samples) for r in encoder.table.collect()}
    prior = encoder.prior.first()
    assert found["B"] == (prior.posterior_mean, 1) and prior.n_samples == 6
    assert found["A"][0] != prior.posterior_mean


def test_smoothing_literals(spark):
    df = spark.createDataFrame([("red", 1), ("blue", 0), ("blue", 0), ("blue", 0)], "team string, won long")
    raw = table_of(fit_target_encoder(df, ["team"], "won", 0.0), "team", "encoded")
    assert raw == {"red": (1.0,), "blue": (0.0,)}
    pulled = table_of(fit_target_encoder(df, ["team"], "won", 1.0), "team", "encoded")
    assert pulled == {"red": (pytest.approx(0.625),), "blue": (pytest.approx(0.0625),)}


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        c = rng.choice(["a", "a", "a", "b", None])
        e = rng.choice(["x", "y_z"])
        y = None if rng.random() < 0.1 else float(rng.random() < 0.4)
        rows.append((i, c, e, y, rng.randrange(4), rng.gauss(1e3, 5.0)))
    rows.append((120, "only", "x", 1.0, 0, 1000.0))
    schema = "id int, c string, e string, y double, fold int, v double"
    return rows, spark.createDataFrame(rows, schema)


def test_oof_smoothed_means(folded):
    rows, df = folded
    found, _ = target_encode(df, ["c"], "y", fold_col="fold", smoothing=2.0, suffix="_te")
    found = by_id(found, "c_te")
    assert len(found) == len(rows)
    for i, c, _, _, fold, _ in rows:
        others = [r for r in rows if r[4] != fold and r[3] is not None]
        mean = sum(r[3] for r in others) / len(others)
        mine = [r[3] for r in others if r[1] == c]
        expected = (sum(mine) + 2.0 * mean) / (len(mine) + 2.0) if mine else mean
        assert found[i] == pytest.approx(expected)


def test_oof_normal_gamma_composite(folded):
    rows, df = folded
    found, _ = bayesian_target_encode(
        df, [["c", "e"]], "v", "continuous", fold_col="fold", prior_weight=3.0, min_samples_leaf=4
    )
    found = by_id(found, "c_e_te", "c_e_te_var")
    for i, c, e, _, fold, _ in rows:
        others = [r for r in rows if r[4] != fold]
        prior = sum(r[5] for r in others) / len(others)
        mine = [r[5] for r in others if (r[1], r[2]) == (c, e)]
        used = mine if len(mine) >= 4 else [r[5] for r in others]
        n, mean = len(used), sum(used) / len(used)
        ss = sum((x - mean) ** 2 for x in used)
        beta = 1 + ss / 2 + 3.0 * n * (mean - prior) ** 2 / (2 * (3.0 + n))
        assert found[i][0] == pytest.approx((3.0 * prior + n * mean) / (3.0 + n))
        assert found[i][1] == pytest.approx(beta / ((1 + n / 2) * (3.0 + n)))


def test_oof_does_not_see_its_own_fold(folded):
    _, df = folded
    changed = df.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    for encode in (
        lambda t: target_encode(t, ["c"], "y", fold_col="fold", suffix="_te")[0],
        lambda t: bayesian_target_encode(t, ["c"], "y", fold_col="fold")[0],
    ):
        before = by_id(encode(df).where("fold = 2"), "c_te")
        assert before == pytest.approx(by_id(encode(changed).where("fold = 2"), "c_te"))
        rest = by_id(encode(df).where("fold <> 2"), "c_te")
        assert rest != pytest.approx(by_id(encode(changed).where("fold <> 2"), "c_te"))


def test_names_and_replacement(people):
    replaced, _ = target_encode(people, ["team"], "won", "id", 3)
    assert replaced.columns == people.columns and dict(replaced.dtypes)["team"] == "double"
    kept, _ = target_encode(people, ["team"], "won", "id", 3, prefix="enc_")
    assert dict(kept.dtypes)["team"] == "string" and "enc_team" in kept.columns
    bayes, _ = bayesian_target_encode(people, ["team"], "won", keys="id", n_splits=3, output_variance=False)
    assert bayes.columns == [*people.columns, "team_te"]
    with pytest.raises(ValueError):
        target_encode(people, ["team"], "won")
    with pytest.raises(ValueError):
        target_encode(people, [["team", "id"], "team_id"], "won", "id")


def test_several_columns_at_once(folded):
    _, df = folded
    both, encoders = target_encode(df, ["c", "e"], "y", fold_col="fold", suffix="_te")
    alone, _ = target_encode(df, ["e"], "y", fold_col="fold", suffix="_te")
    assert by_id(both, "e_te") == by_id(alone, "e_te") and set(encoders) == {"c", "e"}


def test_unknown_categories_get_the_prior(spark, people):
    test = spark.createDataFrame([(1, "red"), (2, "green"), (3, None)], "id int, team string")
    smooth = transform_target_encode(test, fit_target_encoder(people, ["team"], "won"), ["team"], suffix="_te")
    assert by_id(smooth, "team_te") == {1: pytest.approx(1.5 / 4), 2: 0.5, 3: 0.5}
    bayes = fit_bayesian_encoder(people, ["team"], "won", "binary", 2.0)
    assert by_id(transform_bayesian_target_encode(test, bayes, ["team"]), "team_te") == {
        1: pytest.approx(0.4), 2: pytest.approx(0.5), 3: pytest.approx(0.5)
    }


def test_composite_keys_do_not_collide(spark):
    rows = [(1, "a_b", "c", 1), (2, "a", "b_c", 0), (3, "a_b", "c", 1), (4, "a", "b_c", 0)]
    df = spark.createDataFrame(rows, "id int, p string, q string, y int")
    encoder = fit_target_encoder(df, [["p", "q"]], "y", 0.0)["p_q"]
    assert sorted(r.encoded for r in encoder.table.collect()) == [0.0, 1.0]


def test_rows_without_target_are_encoded_not_fitted(spark):
    rows = [(1, "a", 1.0, 0), (2, "a", None, 1), (3, "b", 0.0, 1), (4, "b", float("nan"), 0)]
    df = spark.createDataFrame(rows, "id int, c string, y double, fold int")
    found, encoders = target_encode(df, ["c"], "y", fold_col="fold", smoothing=0.0, suffix="_te")
    assert by_id(found, "c_te") == {1: 0.0, 2: 1.0, 3: 1.0, 4: 0.0}
    assert {r.c: r.encoded for r in encoders["c"].table.collect()} == {"a": 1.0, "b": 0.0}


def test_expanding_literals(spark):
    rows = [(1, "A", 1, "2024-01-01"), (2, "A", 0, "2024-01-02"), (3, "A", 1, "2024-01-03")]
    df = spark.createDataFrame(rows, "id int, Cat string, Target long, Date string")
    found, _ = time_series_target_encode(df, ["Cat"], "Target", "Date", "id")
    assert by_id(found, "Cat_te") == tuple_dict({1: 2 / 3, 2: 5 / 6, 3: 5 / 9})


def tuple_dict(d):
    return {k: pytest.approx(v) for k, v in d.items()}


def test_expanding_min_samples_and_future(spark):
    rows = [(i, "A", i % 2, f"2024-01-0{i}") for i in range(1, 5)]
    df = spark.createDataFrame(rows, "id int, Cat string, Target long, Date string")
    found, full = time_series_target_encode(df, ["Cat"], "Target", "Date", "id", min_samples=3)
    codes = by_id(found, "Cat_te")
    assert [codes[i] for i in (1, 2, 3)] == [0.5] * 3 and codes[4] == pytest.approx(2.5 / 4)
    assert full["Cat"].table.first().n_samples == 4
    # Only the own past counts; with a past-only prior the future has no effect at all.
    future = df.withColumn("Target", F.when(F.col("id") == 4, 1).otherwise(F.col("Target")))
    options = dict(target_type="continuous", prior="past")
    a = time_series_target_encode(df, ["Cat"], "Target", "Date", "id", **options)[0].where("id < 4")
    b = time_series_target_encode(future, ["Cat"], "Target", "Date", "id", **options)[0].where("id < 4")
    assert by_id(a, "Cat_te") == by_id(b, "Cat_te")


def test_expanding_with_ties_and_many_partitions(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randrange(20), float(rng.randrange(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, c string, t int, y double").repartition(4)
    found, _ = time_series_target_encode(df, ["c"], "y", "t", "id", "continuous", 2.0, num_partitions=9)
    found, g, past = by_id(found, "c_te"), sum(r[3] for r in rows) / len(rows), {}
    for i, c, _, y in sorted(rows, key=lambda r: (r[2], r[0])):
        seen = past.setdefault(c, [])
        assert found[i] == pytest.approx((2 * g + sum(seen)) / (2 + len(seen)) if seen else g)
        seen.append(y)


def test_merged_folds_give_the_moments_of_the_whole(folded):
    _, df = folded
    whole, parted = (
        fit_bayesian_encoder(df, ["c"], "y", "continuous", 2.0),
        bayesian_target_encode(df, ["c"], "y", "continuous", fold_col="fold", prior_weight=2.0)[1],
    )
    columns = ("n_samples", "posterior_mean", "posterior_var", "beta_post")
    a, b = table_of(whole, "c", *columns), table_of(parted, "c", *columns)
    assert set(a) == set(b) and all(b[k] == pytest.approx(a[k]) for k in a)


def test_folds_without_targets_keep_the_variance(spark):
    rows = [(i, "a", float(i), i % 2) for i in range(8)] + [(8, "a", None, 2), (9, "a", None, 3)]
    df = spark.createDataFrame(rows, "id int, c string, y double, fold int")
    found, _ = bayesian_target_encode(df, ["c"], "y", "continuous", fold_col="fold")
    codes = by_id(found, "c_te", "c_te_var")
    # Rows of fold 2 see 0..7: mean 3.5, square sum 42, prior 3.5.
    assert codes[8] == (pytest.approx(3.5), pytest.approx((1 + 21) / (5 * 9)))


def test_large_encoder_takes_a_shuffled_join(folded, monkeypatch):
    from foldwise.plans import small

    _, df = folded
    expected = by_id(target_encode(df, ["c"], "y", fold_col="fold", suffix="_te")[0], "c_te")
    monkeypatch.setattr(small.broadcast_within, "__defaults__", (0,))
    found, _ = target_encode(df, ["c"], "y", fold_col="fold", suffix="_te")
    assert by_id(found, "c_te") == pytest.approx(expected)


def test_many_folds_are_linear_and_agree_with_windows(spark, monkeypatch):
    from foldwise.operators import encode

    df = spark.range(4000).selectExpr(
        "id", "CAST(id % 3 AS string) AS c", "sin(id) * 100 + 1e6 AS y", "IF(id % 2000 = 7, NULL, id % 2000) AS f"
    )
    found = {}
    for limit in (0, 10_000):
        monkeypatch.setattr(encode, "_WINDOW_FOLDS", limit)
        coded, _ = encode.bayesian_target_encode(df, ["c"], "y", "continuous", fold_col="f")
        found[limit] = {r.id: (r.c_te, r.c_te_var) for r in coded.collect()}
        # No window over all folds, no array of folds.
        if not limit:
            assert "collect_list" not in coded._jdf.queryExecution().toString()
    assert found[0].keys() == found[10_000].keys()
    for i, (mean, var) in found[0].items():
        assert mean == pytest.approx(found[10_000][i][0], rel=1e-12)
        other = found[10_000][i][1]
        assert (var is None) == (other is None) and (var is None or var == pytest.approx(other, rel=1e-6))
