"""Refreshes of the monthly states against full builds."""
import datetime as dt
import glob
import os
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from trendspark.operators import timeseries as ts
from trendspark.plans import incremental as I

RECORD = "sector_label string, stage string, date timestamp_ntz, amount_usd double"
SPEC = I.MonthlySpec(("sector_label", "stage"), "date", (("n", "count(*)"), ("amount", "sum(amount_usd)")))


def records(seed, months, n=60):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None]), rnd.choice(["seed", "late", None]), rnd.choice([None] + [dt.datetime(2020, m, rnd.randint(1, 28), 5) for m in months]),
             rnd.choice([None, float(rnd.randint(1, 99))])) for _ in range(n)]


def full(df):
    return sorted(map(tuple, df.where("date is not null").groupBy(ts.month_floor("date").cast("date").alias("month"), "sector_label", "stage")
                      .agg(F.count("*").alias("n"), F.sum("amount_usd").alias("amount")).collect()), key=str)


def test_refresh_reads_new_files_and_writes_their_months(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="trendspark-inc-", dir="/tmp")
    schema = spark.createDataFrame([], RECORD).schema
    land = lambda name, rows: spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(f"{base}/in/{name}")
    os.makedirs(f"{base}/in")
    m = I.MonthlyStates(spark, f"{base}/in", f"{base}/home", SPEC, schema)
    have = lambda: sorted(map(tuple, m.monthly().collect()), key=str)
    want = lambda: full(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in"))
    assert have() == [] and m.refresh() == {"files_read": 0, "files_gone": 0, "months_written": 0} and have() == []
    land("one", records(1, [1, 2, 3]))
    land("two a+b", records(2, [3, 4]))   # odd characters in a path
    assert m.refresh() == {"files_read": 2, "files_gone": 0, "months_written": 4} and have() == want()
    assert m.refresh() == {"files_read": 0, "files_gone": 0, "months_written": 0} and have() == want()
    land("three", records(3, [4, 5]))
    assert m.refresh() == {"files_read": 1, "files_gone": 0, "months_written": 2} and have() == want()
    # a refresh that dies before its manifest changes nothing, and is run again
    land("four", records(4, [1]))
    before = have()
    write = I.MonthlyStates._manifest
    monkeypatch.setattr(I.MonthlyStates, "_manifest", lambda self, what, s: (_ for _ in ()).throw(RuntimeError("lost")) if what == "months" else write(self, what, s))
    with pytest.raises(RuntimeError):
        m.refresh()
    monkeypatch.setattr(I.MonthlyStates, "_manifest", write)
    assert have() == before
    assert m.refresh() == {"files_read": 1, "files_gone": 0, "months_written": 1} and have() == want()
    # a file goes, another one is replaced
    shutil.rmtree(f"{base}/in/three")
    shutil.rmtree(f"{base}/in/one")
    land("one", records(5, [2, 9]))
    got = m.refresh()
    assert got["files_read"] == 1 and got["files_gone"] == 2 and have() == want()
    assert dt.date(2020, 5, 1) not in {r[0] for r in have()}
    assert len(glob.glob(f"{base}/home/monthly/version=*")) == 6


def test_panel_from_the_monthly_table(spark):
    base = tempfile.mkdtemp(prefix="trendspark-inc-", dir="/tmp")
    df = spark.createDataFrame(records(7, range(1, 13), 300), RECORD)
    for i, part in enumerate(df.randomSplit([.3, .3, .4], 1)):
        part.coalesce(1).write.parquet(f"{base}/in/{i}")
    m = I.MonthlyStates(spark, f"{base}/in", f"{base}/home", SPEC, df.schema)
    m.refresh()
    features = [ts.Trailing("rate", "n", 3), ts.Trailing("mean", "amount", 6, "n")]
    end = dt.datetime(2021, 2, 1)
    got = I.trailing_from(m.monthly(), ["sector_label"], end, features)
    monthly = ts.monthly(df.where("date is not null"), ["sector_label"], "date", {"n": F.count("*"), "amount": F.sum("amount_usd")})
    spine = ts.month_spine(spark, "_start", end, bounds=monthly.agg(F.min(ts.TS).alias("_start")))
    want = ts.trailing_panel(monthly, ["sector_label"], spine, features)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
