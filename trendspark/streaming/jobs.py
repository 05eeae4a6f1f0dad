"""Incremental jobs over landed event files (ST-1 .. ST-3).

Each job is a Structured Streaming query with a file source, an
``availableNow`` trigger (process what has landed, then stop — the same
code runs continuously with a processing-time trigger), a checkpoint
location for exactly-once file sinks, and event-time watermarks for state.
A job that shall go on where it stopped is given its ``Place`` (sink and
checkpoint folders) by the caller; without one it gets new folders under the
cluster's checkpoint folder and is a run of its own.
"""
from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators import monitor as mo
from trendspark.params import MonitorParams
from trendspark.session import ensure_checkpoint_dir
from trendspark.sources.scan import path_exists


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Place:
    """Folders of a job, in a file system that all executors share."""
    sink: str
    checkpoint: str


def new_place(spark: SparkSession, name: str) -> Place:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trendspark-streams/{name}-{uuid.uuid4().hex}"
    return Place(f"{base}/sink", f"{base}/checkpoint")


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state in RocksDB (local disk, saved to the checkpoint folder)
    instead of the executors' heap, unless the session names a store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", ROCKSDB).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def event_stream(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """File source over ``folder`` restricted to files matching ``file_glob``;
    event time as an instant whose UTC wall clock is the record's wall clock."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder).withColumn("event_time", wall_clock_as_utc("ts"))


def wall_clock_as_utc(col: str):
    """timestamp_ntz → instant, reading the wall clock as UTC whatever the
    session time zone (windows then align to wall-clock days)."""
    c = F.col(col)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def utc_wall_clock(spark: SparkSession, c):
    """instant → timestamp_ntz wall clock in UTC (inverse of the above)."""
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit(session_tz), F.lit("UTC"), c.cast("timestamp_ntz"))


def _run(query_df: DataFrame, place: Place, mode: str = "append") -> DataFrame:
    spark = query_df.sparkSession
    q = (query_df.writeStream.format("parquet").option("path", place.sink).option("checkpointLocation", place.checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(place.sink)


def valid_events(stream: DataFrame) -> DataFrame:
    """Events with id, time and type and a value that is not negative."""
    return stream.where(F.col("event_id").isNotNull() & F.col("event_time").isNotNull()
                        & F.col("event_type").isNotNull() & (F.coalesce(F.col("value"), F.lit(0.0)) >= 0))


def landing_writer(stream: DataFrame, place: Place):
    """ST-1 as a writer, to be started with the trigger the caller wants.

    Every valid event is landed once, however late it comes again: the ids
    seen so far are keyed state, partitioned by id and kept in RocksDB, so a
    batch looks up its own ids and the landed table is never read. The file
    sink's log makes each batch's files visible once; a job stopped at any
    point and started again at its ``Place`` goes on with files not yet read.
    The state holds one id per landed event: its size is the price of landing
    without a bound on lateness."""
    keep_state_on_disk(stream.sparkSession)
    new = valid_events(stream).dropDuplicates(["event_id"]).withColumn("event_date", F.to_date("ts")).drop("event_time")
    return (new.writeStream.format("parquet").option("path", place.sink).option("checkpointLocation", place.checkpoint)
            .partitionBy("event_date").outputMode("append"))


def landed_events(spark: SparkSession, place: Place, schema: T.StructType) -> DataFrame:
    """What has been landed at ``place`` (nothing yet: no rows)."""
    if not path_exists(spark, f"{place.sink}/_spark_metadata"):
        return spark.createDataFrame([], schema)
    landed = T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(landed).parquet(place.sink).drop("event_date")


def land_events(stream: DataFrame, place: Place | None = None) -> DataFrame:
    """ST-1: land what has come, then stop; see ``landing_writer``."""
    spark = stream.sparkSession
    place = place or new_place(spark, "landing")
    landing_writer(stream, place).trigger(availableNow=True).start().awaitTermination()
    return landed_events(spark, place, stream.drop("event_time").schema)


def rolling_rates(stream: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "1 day",
                  place: Place | None = None) -> DataFrame:
    """ST-2: sliding event-time windows per event type, emitted once closed
    by the watermark (append mode)."""
    agg = (stream.withWatermark("event_time", delay)
           .groupBy(F.window("event_time", length, slide), "event_type")
           .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value")))
    spark = stream.sparkSession
    out = agg.select(utc_wall_clock(spark, F.col("window.start")).alias("window_start"),
                     utc_wall_clock(spark, F.col("window.end")).alias("window_end"), "event_type",
                     "n_events", "total_value")
    return _run(out, place or new_place(spark, "rolling-rates"))


def _state_of(spark: SparkSession, states: str, batch_id: int, schema: T.StructType) -> DataFrame | None:
    """The state table that the batch before has left (a folder per batch)."""
    before = f"{states}/{batch_id - 1}"
    return spark.read.schema(schema).parquet(before) if batch_id and path_exists(spark, before) else None


def health_per_batch(stream: DataFrame, now: dt.datetime, params: MonitorParams = MonitorParams(),
                     place: Place | None = None) -> DataFrame:
    """ST-3: after every micro-batch of status rows, the pipeline health (MO-2)
    by the latest status of each pipeline seen so far, with the batch id. The
    latest-status table (a row a pipeline) and the report of a batch are
    written to folders of the batch, so a replayed batch repeats its result."""
    spark = stream.sparkSession
    place = place or new_place(spark, "health")
    states = f"{place.sink}-latest"
    expected = mo.expected_pipelines(spark, params)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        before = _state_of(spark, states, batch_id, batch.schema)
        rows = batch if before is None else batch.unionByName(before)
        rest = [c for c in rows.columns if c != "pipeline_name"]
        last = F.max_by(F.struct(*rest), F.struct("last_run_timestamp", "row_key"))  # a partial aggregate: raw rows are not moved
        state = rows.groupBy("pipeline_name").agg(last.alias("_r")).select("pipeline_name", "_r.*").select(*rows.columns)
        state.write.mode("overwrite").parquet(f"{states}/{batch_id}")
        latest = mo.latest_status(spark.read.schema(batch.schema).parquet(f"{states}/{batch_id}"), tie="row_key")
        health = mo.pipeline_health(mo.status_lookup(latest, expected), now)
        health.write.mode("overwrite").parquet(f"{place.sink}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", place.checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(place.sink)


def drift_per_batch(stream: DataFrame, keys: list[str], baseline: DataFrame, params: MonitorParams = MonitorParams(),
                    place: Place | None = None) -> DataFrame:
    """ST-3: after every micro-batch of feature rows, the drift report (MO-4)
    over all rows seen so far, with the batch id and the rows behind each mean.

    The state is running moments (count, mean, M2) per group and feature: a
    batch is reduced to its own moments by a partial aggregate and merged with
    those of the batch before, so no batch is read twice and the state is
    groups x features rows. State and report of a batch are folders of the
    batch: a replayed batch repeats them."""
    spark = stream.sparkSession
    place = place or new_place(spark, "drift")
    states = f"{place.sink}-moments"
    features = [f for f in params.drift_thresholds if f in stream.columns]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = mo.moments(batch, keys, features)
        before = _state_of(spark, states, batch_id, fresh.schema)
        state = fresh if before is None else mo.merge_moments(fresh.unionByName(before), keys)
        state.write.mode("overwrite").parquet(f"{states}/{batch_id}")
        state = spark.read.schema(fresh.schema).parquet(f"{states}/{batch_id}")
        mo.drift_of_moments(state, keys, baseline, params).write.mode("overwrite").parquet(f"{place.sink}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", place.checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(place.sink)
