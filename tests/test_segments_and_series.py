from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.buckets import Bands, time_bucket
from tallyglass.functions.ordering import previous_value
from tallyglass.operators import segments as G, series as T
from tallyglass.operators.segments import Dimension

SEGMENTS = "dimension string, kind string, label string, n bigint, total double, avg double"


def made(spark, *groups, dimension="d"):
    return spark.createDataFrame(
        [(dimension, "categorical", label, n, total, None if total is None else total / n)
         for label, n, total in groups], SEGMENTS)


def test_bands_of_ages(spark):
    bands = Bands.between(18, 72)
    assert bands == Bands(18, 11)
    ages = spark.createDataFrame([(18,), (28,), (29,), (72,)], "age int")
    labels = [r[0] for r in ages.select(bands.label(bands.index(F.col("age")))).collect()]
    assert labels == ["18–28", "18–28", "29–39", "62–72"]
    assert Bands.between(5, 5) is None


def test_gradient_gives_power(spark):
    groups = made(spark, ("18–28", 100, 10_000.0), ("40–50", 100, 20_000.0),
                  ("62–72", 100, 40_000.0))
    stats = G.segment_stats(groups).first()
    assert stats.cv > 0.3 and stats.power > 0
    driver = G.drivers(groups, G.segment_stats(groups)).first()
    assert (driver.driver, driver.from_label, driver.to_label) == ("gradient", "18–28", "62–72")
    assert driver.strength == pytest.approx(4.0)


def test_concentration_without_a_measure(spark):
    groups = made(spark, ("Paris", 800, None), ("Lyon", 100, None), ("Lille", 100, None))
    stats = G.segment_stats(groups).first()
    assert stats.top_share > 0.7 and stats.hhi > 1 / 3 and stats.cv == 0
    driver = G.drivers(groups, G.segment_stats(groups)).first()
    assert (driver.driver, driver.from_label) == ("concentration", "Paris")


def test_dimensions_need_two_to_twentyfive_groups(spark):
    df = spark.range(600).selectExpr(
        "id", "'only' as one", "id % 25 as many", "id % 26 as toomany",
        "if(id % 3 = 0, null, id % 2) as gaps")
    dims = [Dimension.category(c) for c in ("one", "many", "toomany", "gaps")]
    kept = {r.dimension: r.k for r in G.segment_by(df, dims).groupBy("dimension").agg(
        F.count("*").alias("k")).collect()}
    assert kept == {"many": 25, "gaps": 2}


def test_all_dimensions_are_measured_and_the_rejected_named(spark):
    df = spark.range(200).selectExpr("id", *[f"id % {k + 2} as d{k}" for k in range(10)],
                                     "id as each", "0.004D as rate")
    dims = [Dimension.category(f"d{k}") for k in range(10)] + [Dimension.category("each")]
    groups = G.segment_by(df, dims, "rate")
    assert {r.dimension for r in groups.collect()} == {f"d{k}" for k in range(10)}
    assert groups.where("dimension = 'd0'").agg(F.sum("total")).first()[0] == pytest.approx(0.8)
    assert [r.dimension for r in G.rejected_dimensions(groups, dims).collect()] == ["each"]
    assert G.segment_by(df, []).count() == 0


def test_second_dimension_prefers_another_column_and_not_time(spark):
    stats = spark.createDataFrame(
        [("age", "band", 0.9), ("age by two", "band", 0.8), ("month", "temporal", 0.7),
         ("city", "categorical", 0.1)], "dimension string, kind string, power double")
    bases = {"age": "age", "age by two": "age", "month": "d", "city": "city"}
    assert G.second_dimension(stats, bases) == ("age", "city")
    assert G.second_dimension(stats.where("dimension <> 'city'"), bases) == ("age", "month")


def test_all_dimensions_share_one_scan_and_bounded_windows(spark):
    df = spark.range(100).selectExpr("id % 3 as a", "id % 4 as b", "id as v")
    plan = G.segment_by(df, [Dimension.category("a"), Dimension.category("b")], "v")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Range (") == 1
    assert final.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("unit, expected", [
    ("day", "2024-05-15"), ("week", "2024-05-13"), ("month", "2024-05-01"),
    ("quarter", "2024-04-01"), ("year", "2024-01-01"),
])
def test_time_buckets(spark, unit, expected):
    df = spark.sql("select timestamp_ntz '2024-05-15 13:00:00' as t")
    assert str(df.select(time_bucket("t", unit)).first()[0]) == expected


def line(spark, *values):
    return spark.createDataFrame(
        [(f"2024-{i:02d}", float(v)) for i, v in enumerate(values, 1)],
        "period string, value double")


def test_dates_kept_as_text_are_read_and_impossible_ones_left_out(spark):
    df = spark.createDataFrame(
        [("2024-01-05", 1.0), ("2024-01-09 10:00", 2.0), ("2024-13-45", 4.0), (None, 8.0)],
        "d string, v double")
    assert [tuple(r) for r in T.monthly_series(df, "d", "v").collect()] == [("2024-01", 3.0)]


def test_a_series_that_collapses(spark):
    fallen = line(spark, 100, 110, 105, 30)
    trend = T.trend(fallen).first()
    assert (trend.category, trend.severity) == ("trend", "high")
    assert trend.pct == pytest.approx(-70)
    drop = T.period_drops(fallen).collect()
    assert [r.period for r in drop] == ["2024-04"]
    assert T.trend_step(fallen).first().low_period == "2024-04"
    read = T.read_series(fallen, "period", "value").first()
    assert (read.direction, read.max_period, read.min_period) == ("fall", "2024-02", "2024-04")
    assert [r.period for r in T.ruptures(fallen, "period", "value").collect()] == ["2024-04"]


def test_a_stable_series_says_nothing(spark):
    calm = line(spark, 100, 101, 99, 100, 101, 100, 100)
    assert T.trend(calm).isEmpty() and T.period_drops(calm).isEmpty()
    assert T.outliers(calm.where("value = 100")).isEmpty()
    assert T.read_series(calm, "period", "value").first().direction == "stable"


def test_outliers_need_six_periods(spark):
    assert T.outliers(line(spark, 1, 1, 1, 1, 50)).isEmpty()
    assert T.outliers(line(spark, 1, 1, 1, 1, 1, 1, 50)).first().period == "2024-07"


def test_previous_value_equals_a_plain_scan_when_one_key_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "cold", i * 7919 % 400_000,
             None if rng.random() < 0.2 else rng.random()) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, s int, v double").selectExpr(
        "k", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) as t", "v")
    got = {(r.k, r.t): r.p for r in previous_value(df, "t", "v", "p", ("k",), "day").collect()}
    last, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        want[r.k, r.t] = last.get(r.k)
        if r.v is not None:
            last[r.k] = r.v
    assert got == want


def test_calendar_units_are_used_on_request(spark):
    df = spark.range(4000).selectExpr(
        "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as t",
        "cast(id as double) as v")
    assert previous_value(df, "t", "v", "p", unit="minute").where(
        "v > 0 and p <> v - 1 or v > 0 and p is null").isEmpty()


def test_projection_and_allocation(spark):
    df = spark.createDataFrame([(10.0,), (30.0,)], "v double")
    plan = G.project(df, "v", 10).first()
    assert plan.projected == pytest.approx(44) and plan.delta == pytest.approx(4)
    groups = made(spark, ("a", 1, 30.0), ("b", 1, 10.0))
    gain = G.allocate_gain(groups, 4.0, "d").orderBy("rank").collect()
    assert [(r.label, r.gain) for r in gain] == [("a", pytest.approx(3)), ("b", pytest.approx(1))]
