"""Alignment and training data from callers' frames: empty-frame rules, the
choice of date column and target, fits on training rows, dropped rows."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendspark.plans import frames as FR

K = ["sector_label"]


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def month(m, y=2020):
    return dt.datetime(y, m, 1)


def test_date_column_is_chosen_in_order(spark):
    df = frame(spark, [("a", month(1), "2020-05-01", 1.0)], "sector_label string, filing_date timestamp_ntz, date string, x double")
    got = FR.with_time(df, "f")
    assert got.columns == ["sector_label", "filing_date", "x", "ts"] and got.first().ts == month(5)
    assert FR.with_time(df.drop("date"), "f").first().ts == month(1)
    assert FR.with_time(df.withColumn("date", F.lit("no date")), "f") is None
    assert FR.with_time(df.drop("date", "filing_date"), "f") is None
    assert FR.with_time(None, "f") is None and FR.with_time(df.limit(0), "f") is None
    assert FR.with_time(df.withColumn("date", F.lit(None).cast("string")), "f") is None


def test_alignment_without_some_frames(spark):
    p = frame(spark, [("a", month(1), 1.0), (None, month(1), 5.0), ("a", month(3), None)], "sector_label string, filing_date timestamp_ntz, n double")
    f = frame(spark, [("a", month(2), 2.0)], "sector_label string, date timestamp_ntz, n double")
    t = frame(spark, [("a", month(m), 0.1 * m, 9) for m in (1, 2, 3)] + [(None, month(1), 0.5, 9)], "sector_label string, timestamp timestamp_ntz, growth double, other int")
    got = FR.align(p, f, None, t, K)
    assert got.columns == ["sector_label", "ts", "n_patent", "n_funding", "growth"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("a", month(1), 1.0, 2.0, pytest.approx(.1)), ("a", month(2), 1.0, 2.0, pytest.approx(.2)), ("a", month(3), 1.0, 2.0, pytest.approx(.3)),
        (None, month(1), 5.0, None, pytest.approx(.5))], key=str)
    assert FR.align(None, f, None, None, K).columns == ["sector_label", "ts", "n_funding"]
    assert FR.align(None, p.limit(0), None, t, K).columns == ["sector_label", "ts", "growth"]
    assert FR.align(None, None, None, None, K) is None
    named = t.withColumn("target_growth_6m", F.lit(1.0))
    assert FR.align(p, None, None, named, K).columns[-1] == "target_growth_6m"
    assert FR.align(p, None, None, t.select("sector_label", "timestamp"), K).columns == ["sector_label", "ts", "n_patent"]
    # without keys the index is time alone
    assert FR.align(p.where("sector_label = 'a'").drop("sector_label"), None, None, t.where("sector_label = 'a'").drop("sector_label"), []).count() == 2


def training_frames(spark):
    rows = [(s, dt.datetime(2018 + i // 12, i % 12 + 1, 1), float(i if s == "a" else 7), None if s == "b" else float(i % 3)) for s in ("a", "b") for i in range(20)]
    p = frame(spark, rows, "sector_label string, filing_date timestamp_ntz, x double, y double")
    t = p.select("sector_label", F.col("filing_date").alias("ts"), (F.col("x") / 10).alias("target_growth_6m"))
    return p, t


def test_training_rows_and_dropped_ones(spark):
    p, t = training_frames(spark)
    data = FR.prepare_training(p, None, None, t, K, lags=(1,))
    assert data.features == ["x_patent", "y_patent", "x_patent_lag1", "y_patent_lag1"]
    rows = data.rows.collect()
    assert {r.sector_label for r in rows} == {"a"} and len(rows) == 20   # b has no value of y
    assert data.counts.get == {"n_rows": 40, "n_dropped": 20}
    assert sum(r.x_patent for r in rows) == pytest.approx(0, abs=1e-9)


def test_fit_on_training_rows_alone(spark):
    p, t = training_frames(spark)
    rows = sorted(FR.prepare_training(p, None, None, t, K, lags=(1,), fit_fraction=.7).rows.collect(), key=lambda r: r.ts)
    assert sum(r.x_patent for r in rows[:14]) == pytest.approx(0, abs=1e-9)
    assert rows[-1].x_patent == pytest.approx((19 - 6.5) / (sum((i - 6.5) ** 2 for i in range(14)) / 14) ** .5)


def test_nothing_to_train_on(spark):
    p, t = training_frames(spark)
    assert FR.prepare_training(p, None, None, t.withColumnRenamed("target_growth_6m", "growth"), K).rows is None
    assert FR.prepare_training(None, None, None, t, K).rows is None
    assert FR.prepare_training(None, None, None, None, K).rows is None
    assert FR.prepare_training(p, None, None, None, K).rows is None
