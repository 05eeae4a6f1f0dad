"""Alignment, fills, scaling, splits and folds on literal panels."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendspark.operators import timeseries as ts


def _panel(spark, rows, schema="sector_label string, ts timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


def test_ffill_then_bfill(spark):
    d = [dt.datetime(2023, m, 1) for m in (1, 2, 3)]
    df = _panel(spark, [("a", d[0], 1.0), ("a", d[1], None), ("a", d[2], 3.0),
                        ("b", d[0], None), ("b", d[1], 5.0), ("b", d[2], None)])
    got = {(r.sector_label, r.ts.month): r.v for r in ts.ffill_bfill(df, ["sector_label"], ["v"]).collect()}
    assert [got[("a", m)] for m in (1, 2, 3)] == [1.0, 1.0, 3.0]
    assert [got[("b", m)] for m in (1, 2, 3)] == [5.0, 5.0, 5.0]


def test_zscore_population_std_and_minmax(spark):
    df = _panel(spark, [("a", dt.datetime(2023, m, 1), float(m)) for m in range(1, 6)])
    z = sorted(r.v for r in ts.zscore(df, ["sector_label"], ["v"]).collect())
    assert z[0] == pytest.approx(-1.4142135, abs=1e-6) and sum(z) == pytest.approx(0.0, abs=1e-12)
    mm = sorted(r.v for r in ts.minmax(df, ["sector_label"], ["v"]).collect())
    assert mm == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])


def test_constant_column_scales_to_zero(spark):
    df = _panel(spark, [("a", dt.datetime(2023, m, 1), 7.0) for m in range(1, 4)])
    assert {r.v for r in ts.zscore(df, ["sector_label"], ["v"]).collect()} == {0.0}
    assert {r.v for r in ts.minmax(df, ["sector_label"], ["v"]).collect()} == {0.0}


def test_lags_are_row_shifts(spark):
    df = _panel(spark, [("a", dt.datetime(2023, m, 1), float(m)) for m in range(1, 5)])
    rows = ts.lagged(df, ["sector_label"], ["v"], (1, 3)).orderBy("ts").collect()
    assert [r.v_lag1 for r in rows] == [None, 1.0, 2.0, 3.0]
    assert [r.v_lag3 for r in rows] == [None, None, None, 1.0]


def test_expanding_folds_match_time_series_split(spark):
    df = _panel(spark, [("a", dt.datetime(2020 + m // 12, m % 12 + 1, 1), float(m)) for m in range(20)])
    f = ts.expanding_folds(df, ["sector_label"], 3)
    sizes = {(r.fold, r.role): r.n for r in f.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(0, "train"): 5, (0, "test"): 5, (1, "train"): 10, (1, "test"): 5,
                     (2, "train"): 15, (2, "test"): 5}


def test_chrono_split_at_least_one_train_row(spark):
    df = _panel(spark, [("a", dt.datetime(2023, 1, 1), 1.0)])
    assert [r.split for r in ts.chrono_split(df, ["sector_label"]).collect()] == ["train"]


def test_month_spine_starts_inside_range(spark):
    s = ts.month_spine(spark, dt.datetime(2023, 1, 15), dt.datetime(2023, 4, 1))
    assert [r.ts for r in s.orderBy("ts").collect()] == [dt.datetime(2023, m, 1) for m in (2, 3, 4)]


def test_asof_takes_latest_event_and_backfills(spark):
    ev = spark.createDataFrame([("a", dt.datetime(2023, 2, 10), 1.0, 1), ("a", dt.datetime(2023, 2, 20), 2.0, 2),
                                ("a", dt.datetime(2023, 4, 1), 3.0, 3)], "g string, d timestamp_ntz, v double, k int")
    spine = ts.month_spine(spark, dt.datetime(2023, 1, 1), dt.datetime(2023, 5, 1))
    got = {r.ts.month: r.v for r in ts.asof_monthly(ev, ["g"], "d", ["v"], spine, tie=["k"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 2.0, 4: 3.0, 5: 3.0}


def test_ntile_blocks(spark):
    from pyspark.sql import Window
    df = spark.range(8)
    got = [r.b for r in df.select(F.ntile(3).over(Window.orderBy("id")).alias("b")).orderBy("id").collect()]
    assert got == [1, 1, 1, 2, 2, 2, 3, 3]


def test_drop_incomplete(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double")
    assert ts.drop_incomplete(df, ["a", "b"], "any").count() == 1
    assert ts.drop_incomplete(df, ["a", "b"], "all").count() == 2


def test_latest_non_null(spark):
    df = _panel(spark, [("a", dt.datetime(2023, 1, 1), 1.0), ("a", dt.datetime(2023, 2, 1), None)])
    assert ts.latest_non_null(df, ["sector_label"], ["v"]).first().v == 1.0


def test_zscore_fit_on_training_rows_only(spark):
    df = spark.createDataFrame([("a", dt.datetime(2023, m, 1), float(m), "train" if m <= 3 else "test")
                                for m in range(1, 5)], "sector_label string, ts timestamp_ntz, v double, split string")
    got = {r.ts.month: r.v for r in ts.zscore(df, ["sector_label"], ["v"], fit_on=F.col("split") == "train").collect()}
    # train mean 2, population std sqrt(2/3)
    assert got[4] == pytest.approx(2 / (2 / 3) ** 0.5)


def test_check_dates():
    from trendspark.plans.job import check_dates
    with pytest.raises(ValueError):
        check_dates("2023-02-01", "2023-01-01")
    with pytest.raises(ValueError):
        check_dates("2023/01/01", "2023-02-01")
    assert check_dates("2023-01-01", "2023-02-01")[0].month == 1
