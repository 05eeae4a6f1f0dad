"""Registered streaming queries (ST-1 .. ST-3) over the landed events file."""
from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.plans import forecasting as FC
from trendspark.plans.queries_forecast import _DRIFT_CTES, _HEALTH_SQL, _LATEST_SQL, _LOOKUP_SQL, _WATCH, FC_CTES
from trendspark.plans.registry import finish_sql, present, register, with_views
from trendspark.session import materialize_files
from trendspark.streaming import jobs as J


def _events(spark, sf):
    schema = B.table(spark, sf, "events").schema
    return J.event_stream(spark, sf, "events.parquet", schema)


@register("stream_landing", finish_sql("""
select event_id, ts, user_id, event_type, value, props from events
where event_id is not null and ts is not null and event_type is not null and coalesce(value, 0) >= 0""",
    ts=("ts",), d6=("value",)))
def stream_landing(spark, sf):
    return present(J.land_events(_events(spark, sf)))


@register("stream_rolling_rates", finish_sql("""
with w as (
  select event_type, value, date_trunc('day', ts) - to_days(k) as window_start
  from events, range(0, 7) r(k))
select window_start, window_start + INTERVAL 7 DAY as window_end, event_type, count(*) as n_events,
       sum(value) as total_value
from w group by 1, 2, 3
having window_start + INTERVAL 7 DAY <= (select max(ts) from events) - INTERVAL 1 DAY""",
    ts=("window_start", "window_end"), d6=("total_value",)))
def stream_rolling_rates(spark, sf):
    return present(J.rolling_rates(_events(spark, sf)))


@register("stream_health", finish_sql(with_views(["status_log"], f"with {_LATEST_SQL},\n{_LOOKUP_SQL},\n{_HEALTH_SQL}\n"
                                                 "select *, 0 as batch_id from health_all"),
                                      ts=("last_run_timestamp",), ints=("batch_id",)))
def stream_health(spark, sf):
    ev = _events(spark, sf)
    name = (F.when(F.col("event_type") == "click", "patents_pipeline")
            .when(F.col("event_type") == "view", "funding_pipeline")
            .when(F.col("event_type") == "purchase", "research_pipeline").otherwise("main_run"))
    status = ev.select(name.alias("pipeline_name"), F.col("ts").alias("last_run_timestamp"),
                       F.when(F.col("value") >= 20, "SUCCESS").otherwise("FAILED").alias("status"),
                       F.col("props").alias("details"), F.col("event_id").alias("row_key"))
    return present(J.health_per_batch(status, B.STATUS_AS_OF))


_COUNTS = " union all ".join(f"select sector_label, '{f}' as feature, count({f}) as n_values from test_rows group by 1" for f in _WATCH)


@register("stream_drift", finish_sql(FC_CTES + _DRIFT_CTES + f""",
n_of as ({_COUNTS})
select d.*, n.n_values from drift d join n_of n on n.sector_label is not distinct from d.sector_label and n.feature = d.feature""",
    d4=("current_mean", "baseline_mean"), d6=("change",), ints=("n_values",)))
def stream_drift(spark, sf):
    """The panel's test rows come as a file a quarter of the time, a batch
    each; the report after the last batch."""
    sp = FC.split_panel(spark, sf)
    test = sp.where("split = 'test'").drop("split")
    folder = materialize_files(test.repartitionByRange(4, "ts"), "drift-rows")
    rows = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    reports = J.drift_per_batch(rows, ["sector_label"], FC.drift_baseline(spark, sf, sp=sp))
    last = reports.agg(F.max("batch_id").alias("_last"))
    return present(reports.join(F.broadcast(last), F.col("batch_id") == F.col("_last")).drop("batch_id", "_last", "std"),
                   d4=("current_mean", "baseline_mean"))
