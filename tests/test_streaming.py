"""Streaming jobs on the landed events file (smallest tables)."""
import collections
import datetime as dt
import os
import random
import tempfile
import time

import pytest

from trendspark.operators import monitor as mo
from trendspark.params import MonitorParams
from trendspark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    if not os.path.exists(f"{SF}/events.parquet"):
        pytest.skip("test tables not present")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark, schema


def test_rolling_rates_emit_only_closed_windows(events):
    spark, schema = events
    out = J.rolling_rates(J.event_stream(spark, SF, "events.parquet", schema)).collect()
    rows = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type").collect()
    last = max(r.ts for r in rows)
    want = collections.Counter()
    for r in rows:
        day = dt.datetime(r.ts.year, r.ts.month, r.ts.day)
        for k in range(7):
            start = day - dt.timedelta(days=k)
            if start + dt.timedelta(days=7) <= last - dt.timedelta(days=1):
                want[(start, r.event_type)] += 1
    got = {(r.window_start, r.event_type): r.n_events for r in out}
    assert got == dict(want)


def test_landing_keeps_each_valid_event_once(events):
    spark, schema = events
    landed = J.land_events(J.event_stream(spark, SF, "events.parquet", schema))
    src = spark.read.parquet(f"{SF}/events.parquet")
    assert landed.count() == src.where("value >= 0").count()
    assert landed.select("event_id").distinct().count() == landed.count()


EVENT = "event_id long, ts timestamp_ntz, event_type string, value double"


def land_file(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are taken in order of their modification time


def test_landing_goes_on_where_it_stopped(spark):
    base = tempfile.mkdtemp(prefix="trendspark-land-", dir="/tmp")
    day = lambda d: dt.datetime(2024, 1, d, 12)
    schema = spark.createDataFrame([], EVENT).schema
    place = J.Place(f"{base}/sink", f"{base}/checkpoint")
    stream = lambda: J.event_stream(spark, f"{base}/in", "*.parquet", schema, max_files_per_trigger=1)
    land_file(spark, f"{base}/in", [(i, day(1 + i % 3), "view", float(i)) for i in range(10)])
    land_file(spark, f"{base}/in", [(i, day(1 + i % 3), "view", float(i)) for i in range(5, 15)] + [(90, day(1), "view", -1.0), (None, day(1), "view", 1.0)])
    # killed after the first batch has been committed
    q = J.landing_writer(stream(), place).trigger(processingTime="1 hour").start()
    while not os.path.exists(f"{base}/checkpoint/commits/0"):
        time.sleep(.2)
    q.stop()
    assert sorted(r.event_id for r in J.landed_events(spark, place, schema).collect()) == list(range(10))
    # late and repeated events come while it is down
    land_file(spark, f"{base}/in", [(3, day(3), "view", 9.0), (20, day(1), "click", 1.0), (20, day(1), "click", 1.0), (21, dt.datetime(1999, 1, 1), "click", 1.0)])
    q = J.landing_writer(stream(), place).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 16  # the first file is not read again
    rows = {r.event_id: r.value for r in J.landed_events(spark, place, schema).collect()}
    assert sorted(rows) == [*range(15), 20, 21] and rows[3] == 3.0
    assert J.landed_events(spark, place, schema).count() == 17
    again = J.land_events(stream(), place)  # nothing new
    assert again.count() == 17 and again.columns == schema.names


def test_nothing_landed_is_an_empty_table(spark):
    base = tempfile.mkdtemp(prefix="trendspark-land-", dir="/tmp")
    os.makedirs(f"{base}/in")
    schema = spark.createDataFrame([], EVENT).schema
    assert J.land_events(J.event_stream(spark, f"{base}/in", "*.parquet", schema), J.Place(f"{base}/s", f"{base}/c")).count() == 0


def test_drift_of_batches_is_drift_of_all_rows(spark):
    rnd = random.Random(1)
    p = MonitorParams()
    names = list(p.drift_thresholds)
    rows = [(rnd.choice(["a", "b", None]), *[rnd.choice([None, rnd.random() * 10 ** k]) if k != 2 else None if i % 2 else 1e9 + i for k in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "sector_label string, " + ", ".join(f"{n} double" for n in names))
    base = mo.drift_baseline(df.limit(60), names)
    folder = tempfile.mkdtemp(prefix="trendspark-drift-", dir="/tmp")
    for k in range(4):
        spark.createDataFrame(rows[50 * k:50 * k + 50], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    place = J.Place(f"{folder}/sink", f"{folder}/checkpoint")
    reports = J.drift_per_batch(stream(), ["sector_label"], base, p, place)
    assert {r[0] for r in reports.select("batch_id").distinct().collect()} == {0, 1, 2, 3}
    key = lambda r: (str(r.sector_label), r.feature)
    last = {key(r): r for r in reports.where("batch_id = 3").collect()}
    want = {key(r): r for r in mo.drift_check(df, ["sector_label"], base, p).collect()}
    assert set(last) == set(want) and len(want) == 9
    for k, w in want.items():
        assert last[k].status == w.status and last[k].drift_detected == w.drift_detected
        assert last[k].current_mean == pytest.approx(w.current_mean, rel=1e-12)
    for n in names:  # moments are those of all rows
        for r in df.groupBy("sector_label").agg({n: "stddev_samp"}).collect():
            got = [x for k, x in last.items() if k == (str(r[0]), n)]
            assert got[0].std == pytest.approx(r[1], rel=1e-6)
    # a later batch goes on from the state
    spark.createDataFrame(rows[:1], df.schema).write.mode("append").parquet(f"{folder}/in")
    assert J.drift_per_batch(stream(), ["sector_label"], base, p, place).agg({"batch_id": "max"}).first()[0] >= 4
