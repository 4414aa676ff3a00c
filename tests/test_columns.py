"""Projections, arithmetic, labels, joins and imputation on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from foldwise.functions.numeric import arithmetic
from foldwise.operators.columns import (
    confusion_label, drop_nulls, encoded_name, format_column, null_indicators, path_exists,
    plot_columns, sample_weight, select_columns, with_errors,
)
from foldwise.operators.impute import apply_imputer, fill_na
from foldwise.operators.joins import join_tables, lookup
from foldwise.operators.learn import categorical_codes


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1, 1.0, 10.0), (2, 2.0, 0.0), (3, -3.0, 0.0), (4, 0.0, 0.0), (5, None, 5.0)]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_select_keeps_order_and_rejects_unknown(sample):
    assert select_columns(sample, ["b", "id"]).columns == ["b", "id"]
    with pytest.raises(ValueError):
        select_columns(sample, ["nope"])


@pytest.mark.parametrize(
    "operation, expected",
    [
        ("add", [11.0, 2.0, -3.0, 0.0, None]),
        ("subtract", [-9.0, 2.0, -3.0, 0.0, None]),
        ("multiply", [10.0, 0.0, 0.0, 0.0, None]),
    ],
)
def test_arithmetic(sample, operation, expected):
    assert column(arithmetic(sample, operation, "a", "out", "b"), "out") == expected


def test_division_by_zero_follows_ieee(sample):
    out = column(arithmetic(sample, "divide", "a", "out", "b"), "out")
    assert out[:3] == [0.1, math.inf, -math.inf] and math.isnan(out[3]) and out[4] is None


def test_division_of_integers_and_by_negative_zero(spark):
    df = spark.createDataFrame([(1, 7, 2, 0.0), (2, 7, 0, -0.0)], "id int, a int, b int, z double")
    assert column(arithmetic(df, "divide", "a", "out", "b"), "out") == [3.5, math.inf]
    assert column(arithmetic(df, "divide", "a", "out", "z"), "out") == [math.inf, -math.inf]


def test_log1p_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (2, math.e - 1), (3, -1.0), (4, -2.0), (5, None)], "id int, a double")
    out = column(arithmetic(df, "log1p", "a", "out"), "out")
    assert out[0] == 0.0 and out[1] == pytest.approx(1.0) and out[2] == -math.inf
    assert math.isnan(out[3]) and out[4] is None


def test_arithmetic_arguments(sample):
    with pytest.raises(ValueError):
        arithmetic(sample, "add", "a", "out")
    with pytest.raises(ValueError):
        arithmetic(sample, "power", "a", "out", "b")


def test_format_column(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, name string")
    template = "data/{name}/{name}.tif"
    assert column(format_column(df, template, "name", "p"), "p") == ["data/abc/abc.tif", "data/None/None.tif"]
    assert column(format_column(df, template, "name", "p", None), "p") == ["data/abc/abc.tif", None]
    assert column(format_column(df, "fixed", "name", "p"), "p") == ["fixed", "fixed"]


def test_names():
    assert encoded_name("team") == "team"
    assert encoded_name("team", "enc_", "_x") == "enc_team_x"
    assert encoded_name("team", "", "", "_te") == "team_te"


def test_null_helpers(sample):
    assert column(null_indicators(sample, ["a"]), "a_is_null") == [0, 0, 0, 0, 1]
    assert drop_nulls(sample, "a").count() == 4


def test_plot_columns_put_numbers_first(spark):
    df = spark.createDataFrame([("x", 1, True, 2.0)], "s string, i int, f boolean, d double")
    assert plot_columns(df, 3) == ["i", "d", "s"]


def test_errors_and_labels(spark):
    rows = [(1, 1, 0.9), (2, 0, 0.1), (3, 0, 0.8), (4, 1, 0.2), (5, 2, 0.5)]
    df = with_errors(spark.createDataFrame(rows, "id int, y int, p double"), "y", "p")
    assert column(df, "sample_type") == ["TP", "TN", "FP", "FN", "FN"]
    assert column(df, "is_correct") == [1, 1, 0, 0, 0]
    assert column(df, "predicted_label") == [1, 0, 1, 0, 1]
    labels = spark.range(1).select(confusion_label(F.lit(None), F.lit(1)).alias("x"))
    assert labels.first().x == "FN"


def test_sample_weights(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 1, 7.0)], "id int, y int, w double")
    assert column(sample_weight(df, "y", "w", {1: 3}), "sample_weight") == [5.0, 7.0]
    assert column(sample_weight(df, "y", "gone", {1: 3}), "sample_weight") == [1.0, 3.0]
    assert "sample_weight" not in sample_weight(df, "y").columns


def test_path_exists(spark):
    df = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, None)], "id int, path_col string")
    listing = spark.createDataFrame([("/a",), ("/a",), (None,)], "path string")
    assert column(path_exists(df, "path_col", listing), "__image_valid__") == [True, False, False]


def test_joins_rename_clashes_and_keep_null_keys_apart(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "id int, v string")
    left = join_tables([a, b], "id")
    assert left.columns == ["id", "v", "v_right"]
    assert sorted(left.collect(), key=str) == sorted([(1, "a", "x"), (2, "b", None), (None, "c", None)], key=str)
    full = join_tables([a, b], "id", "full")
    assert full.columns == ["id", "v", "id_right", "v_right"] and full.count() == 5
    assert join_tables([a, b], "id", "inner").count() == 1
    assert join_tables([a, b], "id", "semi").columns == ["id", "v"]
    assert join_tables([a, b], "id", "anti").count() == 2
    for bad in ([a], [a, b, b]):
        with pytest.raises(ValueError):
            join_tables(bad, "id")
    for how in ("cross", "full"):
        with pytest.raises(ValueError):
            join_tables([a, b.withColumnRenamed("v", "w"), b.withColumnRenamed("v", "x")], "id", how)
    with pytest.raises(ValueError):
        join_tables([a, b], "id", "asof")


def test_lookup_is_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "new")], "id int, c string")
    model = spark.createDataFrame([("a", 0.1), (None, 0.2)], "c string, code double")
    assert column(lookup(df, model, ["c"], "code", F.lit(9.0), "out"), "out") == [0.1, 0.2, 9.0]


def test_fill_na_strategies(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (5, 5.0), (6, nan)], "id int, x double")
    assert column(fill_na(df, ["x"])[0], "x")[2] == 3.0
    assert column(fill_na(df, ["x"])[0], "x")[5] == 3.0
    three = df.where("id < 4")
    assert column(fill_na(three, ["x"], "mean")[0], "x")[2] == 1.5
    assert column(fill_na(df, ["x"], "constant", -999.0)[0], "x")[2] == -999.0
    with pytest.raises(ValueError):
        fill_na(df, ["x"], "mode")


def test_imputer_of_train_fills_test(spark):
    train = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, x double")
    test = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "id int, x double")
    _, model = fill_na(train, ["x"])
    assert column(apply_imputer(test, model, ["x"]), "x") == [10.0, 2.0, 30.0]


def test_all_missing_column_stays_null(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None)], "id int, x double, y double")
    filled, model = fill_na(df, ["x", "y"])
    assert column(filled, "x") == [None, None] and column(filled, "y") == [1.0, 1.0]
    assert model.first().x is None


def test_categorical_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id int, c string")
    assert column(categorical_codes(df, ["c", "gone"]), "c__index") == [0.0, 1.0, 0.0]
