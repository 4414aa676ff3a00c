"""Global positions, running totals, cuts and quantiles against brute force."""

import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions.hashing import shuffle_order
from foldwise.operators import quantiles
from foldwise.operators.quantiles import exact_quantiles
from foldwise.plans.brackets import coarsen, order_number, rows_at_ranks
from foldwise.plans.cuts import cut_points, even_cut_ranks
from foldwise.plans.ordering import running_totals, running_totals_of, with_row_index


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, one time shared by a third of them, some NULLs."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        time = 50 if rng.random() < 0.33 else rng.randrange(100)
        rows.append((i, key, time, float(rng.randrange(10))))
    return rows, spark.createDataFrame(rows, "id int, k string, t int, v double").repartition(5)


def test_row_index_is_the_sorted_position(skewed):
    rows, df = skewed
    found = {r.id: r.row_index for r in with_row_index(df, ["t", "id"], num_partitions=7).collect()}
    expected = sorted(rows, key=lambda r: (r[2], r[0]))
    assert found == {r[0]: i for i, r in enumerate(expected)}


def test_row_index_of_empty_and_single_row(spark):
    one = spark.createDataFrame([(7,)], "id int")
    assert [r.row_index for r in with_row_index(one, ["id"]).collect()] == [0]
    assert with_row_index(one.where("id < 0"), ["id"]).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_running_totals(skewed, parts):
    rows, df = skewed
    totals = {"n": F.lit(1).cast("long"), "s": F.col("v")}
    found = {r.id: (r.n, r.s) for r in running_totals(df, ["k"], ["t", "id"], totals, parts).collect()}
    seen, expected = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        n, s = seen.get(k, (0, 0.0))
        expected[i] = (n, s)
        seen[k] = (n + 1, s + v)
    assert found == expected


def test_running_totals_without_keys(skewed):
    rows, df = skewed
    found = running_totals(df, [], ["t", "id"], {"n": F.lit(1).cast("long")}, 6).collect()
    assert sorted(r.n for r in found) == list(range(len(rows)))


def test_cut_points_per_stratum(skewed):
    _, df = skewed
    ordered = df.withColumn("h", shuffle_order("id", 1))
    cuts = {r.k: r for r in cut_points(df, ["k"], shuffle_order("id", 1), even_cut_ranks(4)).collect()}
    hashes = {}
    for r in ordered.collect():
        hashes.setdefault(r.k, []).append(r.h)
    assert set(cuts) == set(hashes)
    for k, values in hashes.items():
        values.sort()
        n = len(values)
        assert cuts[k].n == n
        for j in range(1, 4):
            rank = (n // 4) * j + min(j, n % 4)
            assert cuts[k][f"cut_{j - 1}"] == values[rank]


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_quantiles_match_numpy(skewed, interpolation):
    rows, df = skewed
    found = exact_quantiles(df, ["v", "t"], {"a": 0.25, "b": 0.9}, ["k"], interpolation)
    for r in found.collect():
        at = 3 if r["column"] == "v" else 2
        values = sorted(float(x[at]) for x in rows if x[1] == r.k)
        for name, q in (("a", 0.25), ("b", 0.9)):
            if interpolation == "linear":
                assert r[name] == pytest.approx(np.quantile(values, q))
            else:
                assert r[name] == values[int((len(values) - 1) * q + 0.5)]


def test_group_quantiles_of_all_sizes(spark):
    """Groups of 1 to 60,000 rows, a third of all in one, ties, infinities, NaN and NULL."""
    sizes = [1, 2, 3, 5, 17, 64, 200, 1500, 6000, 20_000, 60_000]
    parts = [
        spark.range(n).select(
            F.lit(None if i == 3 else i).cast("int").alias("g"),
            (F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 100_003).cast("double"))).alias("x"),
            F.when(F.col("id") % 50 == 0, float("-inf")).when(F.col("id") % 7 == 1, float("nan"))
            .when(F.col("id") % 7 == 2, None).otherwise(F.col("id") % 11).alias("y"),
        )
        for i, n in enumerate(sizes)
    ]
    df = reduce(lambda a, b: a.unionByName(b), parts)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    found = {(r.g, r["column"]): r for r in exact_quantiles(df, ["x", "y"], wanted, ["g"]).collect()}
    rows = df.toPandas()
    for i, n in enumerate(sizes):
        part = rows[rows.g.isna()] if i == 3 else rows[rows.g == i]
        for column in ("x", "y"):
            values = part[column].dropna().to_numpy()
            r = found[None if i == 3 else i, column]
            for name, q in wanted.items():
                at = (len(values) - 1) * q
                low, high = np.sort(values)[[int(np.floor(at)), int(np.ceil(at))]]
                assert r[name] == pytest.approx(low if low == high else low + (high - low) * (at - np.floor(at)), rel=1e-9, nan_ok=True)


def test_groups_without_a_value_and_a_failed_sketch(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, 4.0), (1, None, 9.0), (2, 5.0, 1.0)], "g int, x double, y double")

    def wrong(df, columns, *_):
        place = F.struct(F.array(F.lit(1e9)).alias("low"), F.array(F.lit(2e9)).alias("high"))
        return df.select("g").distinct().select("g", *[place.alias(n) for n in columns])

    for _ in range(2):
        found = {(r.g, r["column"]): r.m for r in exact_quantiles(df, ["x", "y"], {"m": 0.5}, ["g"]).collect()}
        assert found == {(1, "y"): 6.5, (2, "x"): 5.0, (2, "y"): 1.0}
        monkeypatch.setattr(quantiles, "group_brackets", wrong)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], {"m": 0.5}).first().m == 2.0


def test_brackets_hold_the_quantiles_of_a_large_column(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 200_003).cast("double")).alias("x"),
        "id",
    )
    found = exact_quantiles(df, ["x"], {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    values = np.array([7.0 if i % 3 == 0 else float(i * 7919 % 200_003) for i in range(200_000)])
    assert (found.a, found.b, found.c) == tuple(pytest.approx(np.quantile(values, q)) for q in (0.1, 0.5, 0.99))


def test_coarsening_keeps_the_order(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    at = coarsen(F.col("v"), [(10.0, 12.0), (50.0, 50.0)])
    rows = [(r.v, tuple(r["at"])) for r in df.select("v", at.alias("at")).orderBy("v").collect()]
    assert [at for _, at in rows] == sorted(at for _, at in rows)
    assert {at for v, at in rows if 10 <= v <= 12 or v == 50} == {(10.0, 0), (11.0, 0), (12.0, 0), (50.0, 0)}
    assert {at for v, at in rows if 12 < v < 50} == {(12.0, 1)} and rows[0][1] == (10.0, -1)


AS_TYPE = {
    "int": "t",
    "string": "lpad(CAST(t AS string), 3, '0')",
    "date": "date_add(DATE '2024-03-01', t)",
    "timestamp": "timestamp_micros(1000000000000000 + t * 7)",
    "timestamp_ntz": "CAST(timestamp_micros(1000000000000000 + t * 7) AS timestamp_ntz)",
}


@pytest.mark.parametrize("kind", AS_TYPE)
def test_rows_at_ranks(skewed, spark, kind):
    rows, df = skewed
    df = df.withColumn("t", F.expr(AS_TYPE[kind]))
    assert dict(df.dtypes)["t"] == kind and (order_number(df, "t") is None) == (kind == "string")
    order = [i for _, i in sorted((r[2], r[0]) for r in rows)]
    ranks = [0, 17, 300, 599]
    picked = spark.range(1).select(rows_at_ranks(df, "t", ["id"], ranks, 600).alias("p")).first().p
    assert [p.id for p in picked] == [order[r] for r in ranks]


def test_missed_brackets_fall_back_to_the_full_count(skewed, spark, monkeypatch):

    rows, df = skewed
    wrong = lambda df, columns, q: {c: [(3.0, 3.0)] for c in columns}
    monkeypatch.setattr(quantiles, "quantile_brackets", wrong)
    monkeypatch.setattr(brackets, "quantile_brackets", wrong)
    found = exact_quantiles(df, ["t"], {"a": 0.1, "b": 0.8}).first()
    values = [r[2] for r in rows]
    assert (found.a, found.b) == tuple(pytest.approx(np.quantile(values, q)) for q in (0.1, 0.8))
    picked = spark.range(1).select(rows_at_ranks(df, "t", ["id"], [0, 400], 600).alias("p")).first().p
    order = sorted((r[2], r[0]) for r in rows)
    assert [(p.t, p.id) for p in picked] == [order[0], order[400]]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_totals_of_several_keys(skewed, parts):
    rows, df = skewed
    found = running_totals_of(
        df, {"k": ["k"], "kt": ["k", "t"], "all": []}, ["t", "id"], {"n": F.lit(1), "s": F.col("v")}, parts
    ).collect()
    seen = {name: {} for name in ("k", "kt", "all")}
    got = {r.id: r for r in found}
    assert len(found) == len(rows)
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        for name, key in (("k", k), ("kt", (k, t)), ("all", 0)):
            n, s = seen[name].get(key, (0, 0.0))
            assert (got[i][f"n_{name}"], got[i][f"s_{name}"]) == (n, s)
            seen[name][key] = (n + 1, s + v)


def test_quantiles_melt_only_rows_near_a_rank(spark, monkeypatch):
    """Of a whole table's rows only those inside a bracket are melted; the others are counted in place."""
    melted, whole = [], quantiles.value_counts_long
    monkeypatch.setattr(quantiles, "value_counts_long", lambda df, *a: melted.append(df.count()) or whole(df, *a))
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("x"), (F.col("id") % 5).alias("few"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") * F.lit(-0.5)).alias("y"), F.lit(None).cast("int").alias("none"),
    )
    got = {r["column"]: (r.a, r.b) for r in quantiles.exact_quantiles(df, df.columns, {"a": 0.3, "b": 0.9}).collect()}
    columns = {"x": [i for i in range(n) if i % 7], "few": [i % 5 for i in range(n)], "y": [i * -0.5 for i in range(n) if i % 2]}
    assert got == {c: tuple(pytest.approx(v, rel=1e-12) for v in np.quantile(x, [0.3, 0.9])) for c, x in columns.items()}
    assert len(melted) == 1 and melted[0] < n / 100
