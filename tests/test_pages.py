"""Landed pages: bounds, columns and cap reach the source."""
import datetime as dt
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from trendspark.session import ship_package
from trendspark.sources import pages as PG

ROW = "id long, date timestamp_ntz, amount double, note string"


@pytest.fixture(scope="module")
def landed(spark):
    ship_package(spark)
    at = tempfile.mkdtemp(prefix="trendspark-pages-", dir="/tmp")
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i // 3), float(i), f"n{i}") for i in range(600)] + [(1000, None, 1.0, None)]
    df = spark.createDataFrame(rows, ROW)
    PG.land_pages(df, at, "date", 10)
    return at, df


def spoil(at, spark, since):
    """Pages that lie before a date cannot be read any more."""
    index = spark.read.parquet(f"{at}/index").collect()
    old = [r.file for r in index if r.hi is None or r.hi < since]
    copy = tempfile.mkdtemp(prefix="trendspark-pages-", dir="/tmp")
    os.system(f"cp -r {at}/pages {at}/index {copy}")
    for f in old:
        with open(f"{copy}/pages/{f}", "wb") as out:
            out.write(b"spoilt")
    for f in glob.glob(f"{copy}/pages/.*.crc"):
        os.unlink(f)
    return copy, len(old), len(index)


def test_whole_table(spark, landed):
    at, df = landed
    got = PG.read_pages(spark, at, "date", pages_per_task=3)
    assert got.columns == df.columns and got.rdd.getNumPartitions() >= 3
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_pages_outside_the_dates_are_not_opened(spark, landed):
    at, df = landed
    since, until = dt.datetime(2020, 5, 1), dt.datetime(2020, 5, 9)
    copy, old, all_pages = spoil(at, spark, since)
    assert 0 < old < all_pages
    got = PG.read_pages(spark, copy, "date", ["id"], since, until)
    assert got.columns == ["id"]
    want = df.where(F.col("date").between(F.lit("2020-05-01").cast("timestamp_ntz"), F.lit("2020-05-09").cast("timestamp_ntz")))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()) and got.count() == 27


def test_filters_of_the_query_reach_the_source(spark, landed):
    at, _ = landed
    since = dt.datetime(2020, 6, 1)
    copy, _, _ = spoil(at, spark, since)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = PG.read_pages(spark, copy, "date").where(F.col("date") >= F.lit("2020-06-01").cast("timestamp_ntz"))
        assert rows.count() == 600 - 3 * (since - dt.datetime(2020, 1, 1)).days
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_pages_of_the_newest_rows_are_opened(spark, landed):
    at, df = landed
    copy, old, _ = spoil(at, spark, dt.datetime(2020, 5, 15))
    got = PG.read_pages(spark, copy, "date", ["id", "date"], cap=40).orderBy(F.col("date").desc(), F.col("id").desc()).limit(40)
    assert [r.id for r in got.collect()] == list(range(599, 559, -1))
    reader = PG.PageReader(PG.LandedPages({"path": at, "columns": "id"}).schema(), {"path": at, "dateColumn": "date", "cap": "5"})
    assert len(reader.partitions()) <= 2
