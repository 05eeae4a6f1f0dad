"""Fill, lag and as-of on raw rows against the windows over whole groups, with
one group that holds most rows and lies in many slices."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trendspark.operators import segmented as S

ROWS = "g string, t timestamp_ntz, i long, v double, s string"


def table(spark, n=600, seed=1, hot=.9):
    rnd = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    rows = [("hot" if rnd.random() < hot else rnd.choice(["b", None, "c"]), start + dt.timedelta(minutes=rnd.randint(0, 300)), i,
             rnd.choice([None, None, float(i)]), rnd.choice([None, None, None, None, f"s{i}"])) for i in range(n)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.fixture(autouse=True)
def slices(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small slices stay apart
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_a_hot_group_lies_in_many_slices(spark):
    rows = S.sliced(table(spark), ["g"], ["t", "i"])
    assert rows.where("g = 'hot'").select("__slice").distinct().count() > 5


def test_fill_is_the_window_over_the_group(spark):
    df = table(spark)
    w = Window.partitionBy("g").orderBy("t", "i")
    last = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("v", "s")}
    first = {c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in ("v", "s")}
    same(S.fill(df, ["g"], ["t", "i"], ["v", "s"]), df.select("g", "t", "i", *[last[c].alias(c) for c in last]))
    same(S.fill(df, ["g"], ["t", "i"], ["v", "s"], True, True), df.select("g", "t", "i", *[F.coalesce(last[c], first[c]).alias(c) for c in last]))
    same(S.fill(df, ["g"], ["t", "i"], ["s"], False, True), df.select("g", "t", "i", "v", first["s"].alias("s")))


def test_lag_is_the_window_over_the_group(spark):
    for df in (table(spark), table(spark, 40, 3, .5)):  # slices of fewer rows than the lag
        w = Window.partitionBy("g").orderBy("t", "i")
        want = df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for k in (1, 3, 12) for c in ("v", "s")])
        same(S.lag(df, ["g"], ["t", "i"], ["v", "s"], (1, 3, 12)), want)


def test_as_of_against_brute_force(spark):
    left, right = table(spark, 400, 5).drop("s"), table(spark, 300, 6).select("g", F.col("t").alias("at"), "i", "v", "s")
    rows, events = left.collect(), right.collect()
    for backfill in (False, True):
        want = []
        for r in rows:
            mine = sorted([((e.at, e.i), e) for e in events if e.g == r.g], key=lambda x: x[0])
            before = [e for (at, _), e in mine if at <= r.t]
            e = before[-1] if before else mine[0][1] if backfill and mine else None
            want.append((r.g, r.t, r.i, r.v, e.s if e else None))
        got = S.as_of(left, right, ["g"], "t", "at", ["s"], ["i"], backfill)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_rows_and_no_keys(spark):
    df = table(spark, 30)
    none = df.limit(0)
    assert S.fill(none, ["g"], ["t"], ["v"]).count() == 0 and S.lag(none, ["g"], ["t"], ["v"]).count() == 0
    assert S.as_of(df.drop("s"), df.limit(0), ["g"], "t", "t", ["s"]).where("s is null").count() == 30
    w = Window.orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    same(S.fill(df, [], ["t", "i"], ["v"]), df.select("g", "t", "i", F.last("v", ignorenulls=True).over(w).alias("v"), "s"))


def test_no_frame_runs_to_the_end_of_a_slice(spark):
    # Spark reads such a frame anew for each row: quadratic in the rows of a slice
    plan = S.fill(table(spark, 30), ["g"], ["t", "i"], ["v"], True, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.replace(" ", "").lower() and "unboundedpreceding" in plan.replace(" ", "").lower()
