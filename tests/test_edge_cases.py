"""Missing scores, features, levels and group keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fraudloom.anomaly.knn import impute_knn
from fraudloom.functions.missing import standardize_present
from fraudloom.operators import cost, curves
from fraudloom.operators.relational import assign_window
from fraudloom.plans.application_features import application_features
from fraudloom.plans.window_cost import window_features

NAN = float("nan")


def test_missing_score_is_never_predicted(spark):
    df = spark.createDataFrame([(0.995, 1), (None, 1), (NAN, 0), (1.5, None), (0.2, 0)], "score double, ytrue int")
    rows = {r["threshold"]: r for r in curves.threshold_sweep(df).collect()}
    assert rows[0]["predicted_fraud"] == 2 and rows[0]["total_applications"] == 4
    assert rows[98]["predicted_fraud"] == 1 and rows[99]["precision"] == 1.0 and rows[100]["predicted_fraud"] == 0


def test_nan_score_is_missing_in_curves(spark):
    df = spark.createDataFrame([(0.5, 1), (NAN, 1), (0.1, 0)], "score double, ytrue int")
    assert curves.curve_counts(df, keep=False).count() == 2


def test_window_with_single_levels_stays(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(days=i), float(i), "a" if i < 10 else "ab"[i % 2]) for i in range(22)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, x double, c string")
    got = window_features(df, "id", "ts", 10, ["x"], ["c"])
    assert got.count() == 22
    assert {len(r["vec"]) for r in got.filter("id < 9").collect()} == {1}


def test_windows_lie_over_the_whole_table(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, day + dt.timedelta(days=i)) for i in range(21)], "ca_id long, ts timestamp")
    whole = assign_window(df, "ts", 10)
    part = assign_window(df, "ts", 10, df.filter("ca_id % 5 = 4"))
    want = {tuple(r) for r in whole.filter("ca_id % 5 = 4").collect()}
    assert {tuple(r) for r in part.collect()} == want and want


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    assert cost.contamination_flag(df, "x", 0.5, ["g"]).count() == 3
    assert standardize_present(df, ["x"], "g").count() == 3


def test_imputer_reads_missing_features_as_the_mean(spark):
    rows = [(1, 10.0, 1.0, 1.0), (2, 20.0, None, None), (3, None, 1.0, 1.0), (4, 40.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, t double, a double, b double")
    got = {r["id"]: r["t"] for r in impute_knn(df, "id", "t", ["a", "b"], k=1).collect()}
    assert got[3] == 10.0


def test_payload_keys_are_required(spark):
    df = spark.createDataFrame([("a=1",)], "tmx_raw string")
    with pytest.raises(ValueError):
        application_features(df, spark.createDataFrame([], "a_zip string, tz_offset int"))
