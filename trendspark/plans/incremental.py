"""Rebuild of the changed part (SRC-2, EX-1): monthly states kept per input file.

A folder of record files is reduced to mergeable states, a row per file, group
and month (counts and sums; a category is one more group column). They are
stored apart for each file, under a digest of the file's path, size and
modification time. A refresh lists the folder, reads the files it does not
know, and merges the states of the months that these files (or files that have
gone or changed) touch. Only those months are written again, as a new version
of theirs; a manifest per refresh names the files and the version of each month
that are valid. It is written last, so a refresh that dies at any point leaves
the one before in force and is simply run again.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators import timeseries as ts
from trendspark.sources.scan import path_exists

MONTH = "month"
FILES = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("path", T.StringType()),
                      T.StructField("length", T.LongType()), T.StructField("modified", T.LongType())])
MONTHS = T.StructType([T.StructField(MONTH, T.DateType()), T.StructField("version", T.IntegerType())])


@dataclass(frozen=True)
class MonthlySpec:
    """What a month's state holds: ``keys`` (null is a group), the date
    column, and measures that add up (count, sum) by name."""
    keys: tuple[str, ...]
    date_col: str
    measures: tuple[tuple[str, str], ...]   # (name, SQL aggregate over the records)


class MonthlyStates:
    def __init__(self, spark: SparkSession, folder: str, home: str, spec: MonthlySpec, schema: T.StructType):
        self.spark, self.folder, self.home, self.spec, self.schema = spark, folder.rstrip("/"), home.rstrip("/"), spec, schema

    # -- what is there ---------------------------------------------------
    def files(self) -> DataFrame:
        """The folder's files, listed by Spark; no content is read."""
        f = (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(self.folder).select("path", "length", F.unix_micros("modificationTime").alias("modified")))
        return f.select(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modified").cast("string")), 256).alias("file_id"), *f.columns)

    def _version(self) -> int:
        """The latest refresh that was finished; -1 before the first."""
        v = -1
        while path_exists(self.spark, f"{self.home}/manifest/{v + 1}/months/_SUCCESS"):
            v += 1
        return v

    def _manifest(self, what: str, schema: T.StructType) -> DataFrame:
        v = self._version()
        return self.spark.createDataFrame([], schema) if v < 0 else self.spark.read.schema(schema).parquet(f"{self.home}/manifest/{v}/{what}")

    def _state(self, records: DataFrame) -> DataFrame:
        aggs = [F.expr(e).alias(n) for n, e in self.spec.measures]
        month = ts.month_floor(self.spec.date_col).cast("date").alias(MONTH)
        return records.where(F.col(self.spec.date_col).isNotNull()).groupBy("file_id", *self.spec.keys, month).agg(*aggs)

    def _merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(MONTH, *self.spec.keys).agg(*[F.sum(n).alias(n) for n, _ in self.spec.measures])

    def _state_schema(self) -> T.StructType:
        none = self.spark.createDataFrame([], self.schema).withColumn("file_id", F.lit(""))
        return self._state(none).schema

    # -- refresh -----------------------------------------------------------
    def refresh(self) -> dict[str, int]:
        """Bring the monthly table up to date; the numbers of files read, files
        gone and months written again."""
        spark, version = self.spark, self._version() + 1
        work = f"{self.home}/work/{version}-{time.time_ns()}"
        now, before = self.files(), self._manifest("files", FILES)
        now.write.parquet(f"{work}/files")
        now = spark.read.schema(FILES).parquet(f"{work}/files")
        fresh = now.join(before.select("file_id"), "file_id", "left_anti")
        gone = before.join(now.select("file_id"), "file_id", "left_anti")
        paths = [r["path"] for r in fresh.select("path").collect()]   # the reader takes its files from the driver
        n_gone = gone.count()
        states_at = f"{self.home}/states"
        schema = self._state_schema()
        if paths:
            # the two listings name a file alike once slashes and escapes are made the same
            plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
            read_from = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            records = spark.read.schema(self.schema).parquet(*paths).withColumn("__p", plain(read_from))
            names = fresh.select("file_id", plain(F.col("path")).alias("__p"))
            named = records.join(names.withColumnRenamed("file_id", "__id"), "__p", "left")
            known = F.coalesce("__id", F.raise_error(F.concat(F.lit("file not in the listing: "), F.col("__p"))).cast("string"))
            states = self._state(named.withColumn("file_id", known))
            states.repartition("file_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(states_at)
        if not path_exists(spark, states_at):
            spark.createDataFrame([], schema).write.parquet(states_at)
        states = spark.read.schema(schema).parquet(states_at)
        touched = states.join(fresh.select("file_id").union(gone.select("file_id")), "file_id", "left_semi").select(MONTH).distinct()
        touched.write.parquet(f"{work}/touched")
        touched = spark.read.schema(MONTHS[:1]).parquet(f"{work}/touched")
        live = states.join(now.select("file_id"), "file_id", "left_semi")
        merged = self._merged(live.join(touched, MONTH, "left_semi"))
        at = f"{self.home}/monthly/version={version}"
        merged.repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(at)
        kept = self._manifest("months", MONTHS).join(touched, MONTH, "left_anti")
        written = merged.select(MONTH).distinct().withColumn("version", F.lit(version))
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.home}/manifest/{version}/files")
        kept.unionByName(written).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/manifest/{version}/months")
        return {"files_read": len(paths), "files_gone": n_gone, "months_written": touched.count()}

    def monthly(self) -> DataFrame:
        """The monthly table as of the last finished refresh: month, keys and
        measures of all its files; months that no file holds are not there."""
        merged = self._merged(self.spark.createDataFrame([], self._state_schema())).schema
        if self._version() < 0:
            return self.spark.createDataFrame([], merged)
        parts = T.StructType([*merged.fields, T.StructField("version", T.IntegerType())])
        rows = self.spark.read.schema(parts).parquet(f"{self.home}/monthly")
        return rows.join(self._manifest("months", MONTHS), [MONTH, "version"], "left_semi").select(*merged.names)


def trailing_from(monthly: DataFrame, keys: list[str], end, features: list[ts.Trailing]) -> DataFrame:
    """EX-1's panel from a monthly table (its category columns added up)."""
    sums = [c for c in monthly.columns if c not in keys and c != MONTH and isinstance(monthly.schema[c].dataType, T.NumericType)]
    m = monthly.groupBy(*keys, F.col(MONTH).cast("timestamp_ntz").alias(ts.TS)).agg(*[F.sum(c).alias(c) for c in sums])
    bounds = m.agg(F.min(ts.TS).alias("_start"))
    return ts.trailing_panel(m, keys, ts.month_spine(monthly.sparkSession, "_start", end, bounds=bounds), features)
