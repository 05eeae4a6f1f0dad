"""Pipeline status, health, drift and performance checks (SNK-2/3, JN-8/9, MO-1..6).

The status "table" is an append-only log; the latest row per pipeline is a
``max_by`` aggregate (no MERGE needed). Drift and performance are grouped
aggregates; nothing is collected to the driver.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.functions.scalars import relative_change
from trendspark.operators.common import join_keys, ts_lit
from trendspark.params import MonitorParams

STATUS_SCHEMA = T.StructType([
    T.StructField("pipeline_name", T.StringType()),
    T.StructField("last_run_timestamp", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("details", T.StringType()),
])


def ensure_status_log(spark: SparkSession, path: str) -> None:
    """SNK-3: create an empty status log with the fixed schema if absent."""
    from trendspark.sources.scan import path_exists
    if not path_exists(spark, path):
        spark.createDataFrame([], STATUS_SCHEMA).write.mode("overwrite").parquet(path)


def append_status(spark: SparkSession, path: str, pipeline: str, status: str, details: str = "",
                  at: dt.datetime | None = None) -> None:
    """SNK-2: 'insert or replace' as an append; readers take the latest row."""
    at = at or dt.datetime.now()
    row = [(pipeline, at, status, details)]
    spark.createDataFrame(row, STATUS_SCHEMA).write.mode("append").parquet(path)


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    """The appended status files (schemas merged: extra columns such as a
    tie-break key may appear in later appends)."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def latest_status(log: DataFrame, tie: str | None = None) -> DataFrame:
    """MO-1: latest row per pipeline (partial aggregate; skew-safe)."""
    order = F.struct(F.col("last_run_timestamp"), *([F.col(tie)] if tie else []))
    row = F.max_by(F.struct("last_run_timestamp", "status", "details"), order)
    return log.groupBy("pipeline_name").agg(row.alias("_r")).select(
        "pipeline_name", "_r.last_run_timestamp", "_r.status", "_r.details")


def expected_pipelines(spark: SparkSession, p: MonitorParams = MonitorParams()) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in p.pipelines.items()],
                                 "pipeline_name string, max_delay_days int")


def status_lookup(latest: DataFrame, expected: DataFrame) -> DataFrame:
    """JN-8/JN-9: expected pipelines against the latest status; absent →
    NOT_FOUND with the fixed message."""
    j = expected.join(latest, on="pipeline_name", how="left")
    found = F.col("status").isNotNull() | F.col("last_run_timestamp").isNotNull()
    return j.select("pipeline_name", "max_delay_days", "last_run_timestamp",
                    F.when(found, F.col("status")).otherwise(F.lit("NOT_FOUND")).alias("status"),
                    F.when(found, F.col("details")).otherwise(F.lit("Pipeline status not found in DB.")).alias("details"))


def pipeline_health(lookup: DataFrame, now: dt.datetime) -> DataFrame:
    """MO-2: delayed when there is no timestamp or it is older than the
    allowed delay; failed when status ≠ SUCCESS; overall = all pass."""
    ts = F.col("last_run_timestamp")
    limit = ts_lit(now) - F.make_dt_interval(F.col("max_delay_days"))
    delayed = ts.isNull() | (ts < limit)
    failed = ~F.col("status").eqNullSafe("SUCCESS")
    per = lookup.select("pipeline_name", "last_run_timestamp", "status", delayed.alias("delayed"),
                        failed.alias("failed"), (~delayed & ~failed).alias("healthy"))
    overall = per.agg(F.bool_and("healthy").alias("all_healthy"))  # one row over the configured pipelines
    return per.crossJoin(F.broadcast(overall))


def drift_baseline(df: DataFrame, features: list[str]) -> DataFrame:
    """MO-3: mean and sample std of the watched features present (long table)."""
    present = [f for f in features if f in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "feature string, mean double, std double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                      for f in present])).alias("_kv")).select("_kv.*")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def _long(df: DataFrame, keys: list[str], feats: list[str]) -> DataFrame:
    """One row per group row and feature: keys, feature, value."""
    kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats]))
    return df.select(*keys, kv.alias("_kv")).select(*keys, "_kv.*")


def _no_drift(df: DataFrame, keys: list[str]) -> DataFrame:
    """The empty drift report: none of the watched features is there."""
    none = df.select(*keys).limit(0)
    for name, kind in (("feature", "string"), ("current_mean", "double"), ("baseline_mean", "double"), ("change", "double"),
                       ("status", "string"), ("drift_detected", "boolean")):
        none = none.withColumn(name, F.lit(None).cast(kind))
    return none


def _drift_report(means: DataFrame, keys: list[str], baseline: DataFrame, p: MonitorParams, more: tuple[str, ...] = ()) -> DataFrame:
    thr = means.sparkSession.createDataFrame([(k, float(v)) for k, v in p.drift_thresholds.items()],
                                             "feature string, threshold double")
    # a row per watched feature on either side: bounded by the configuration
    j = (means.join(F.broadcast(baseline.select("feature", F.col("mean").alias("baseline_mean"))), "feature")
         .join(F.broadcast(thr), "feature", "left")
         .where(F.col("current_mean").isNotNull() & F.col("baseline_mean").isNotNull()
                & ~F.isnan("current_mean") & ~F.isnan("baseline_mean")))
    thr_c = F.coalesce(F.col("threshold"), F.lit(p.default_drift_threshold))
    change = relative_change("current_mean", "baseline_mean")
    per = j.select(*keys, "feature", "current_mean", "baseline_mean", change.alias("change"),
                   F.when(change > thr_c, "DRIFT").otherwise("STABLE").alias("status"), *more)
    flags = per.groupBy(*keys).agg(F.bool_or(F.col("status") == "DRIFT").alias("drift_detected"))
    return join_keys(per, flags, keys, "left")


def drift_check(current: DataFrame, keys: list[str], baseline: DataFrame, p: MonitorParams = MonitorParams()) -> DataFrame:
    """MO-4: per group and feature, relative change of the mean against the
    baseline mean; above the feature's threshold → DRIFT. Null means are
    skipped. Adds the group's overall flag."""
    feats = [r for r in p.drift_thresholds if r in current.columns]
    if not feats:
        return _no_drift(current, keys)
    means = _long(current, keys, feats).groupBy(*keys, "feature").agg(F.avg("value").alias("current_mean"))
    return _drift_report(means, keys, baseline, p)


def moments(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Mergeable moments per group and feature: n, mean and m2 (sum of squared
    distances from the mean) of the values that are not null."""
    long = _long(df, keys, features) if features else _no_drift(df, keys).withColumn("value", F.lit(None).cast("double"))
    n = F.count("value")
    return long.groupBy(*keys, "feature").agg(n.alias("n"), F.avg("value").alias("mean"),
                                              (F.var_pop("value") * n).alias("m2"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of several disjoint sets of rows as those of their union: the
    means weighted by their counts, and M2 with the spread between the means.
    ``parts`` holds one row per set, group and feature."""
    sets = F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2")))
    j = parts.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), sets.alias("_s"))
    zero = F.lit(0.0)
    mean = F.try_divide(F.aggregate("_s", zero, lambda a, x: a + x["n"] * x["mean"]), F.col("n"))
    j = j.select(*keys, "feature", "n", mean.alias("mean"), "_s")
    m2 = F.aggregate("_s", zero, lambda a, x: a + x["m2"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return j.select(*keys, "feature", "n", "mean", F.when(F.col("n") > 0, m2).alias("m2"))


def drift_of_moments(state: DataFrame, keys: list[str], baseline: DataFrame, p: MonitorParams = MonitorParams()) -> DataFrame:
    """MO-4 on moments: the report of ``drift_check``, with the number of
    values behind each mean (``n_values``) and their sample deviation (``std``)."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    means = state.select(*keys, "feature", F.col("mean").alias("current_mean"), F.col("n").alias("n_values"), std.alias("std"))
    return _drift_report(means, keys, baseline, p, ("n_values", "std"))


def performance_gate(metrics: DataFrame, keys: list[str], p: MonitorParams = MonitorParams(),
                     groups: DataFrame | None = None) -> DataFrame:
    """MO-5: a group is degraded when any model has MAE above the limit or
    direction accuracy below it (or a metric is missing). ``groups``: all
    groups there should be; one without a model is degraded, with 0 models."""
    bad = ((F.col("mae") > p.max_mae) | (F.col("direction_accuracy") < p.min_direction_accuracy)
           | F.col("mae").isNull() | F.col("direction_accuracy").isNull())
    gate = metrics.groupBy(*keys).agg(F.bool_or(bad).alias("degraded"), F.count(F.lit(1)).alias("n_models"),
                                      F.max("mae").alias("worst_mae"),
                                      F.min("direction_accuracy").alias("worst_direction_accuracy"))
    if groups is None:
        return gate
    return join_keys(groups.select(*keys).distinct(), gate, keys, "left").fillna({"degraded": True, "n_models": 0})
