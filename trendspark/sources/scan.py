"""Parquet scans of landed tables and the load-or-rebuild helper (SRC-1, SRC-2)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, base: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{base.rstrip('/')}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    any scheme the cluster is configured for)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def load_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame],
                  force: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """Use the Parquet at ``path`` when it is there and whole (its writer left
    ``_SUCCESS``), otherwise build, write, and read back (the read-back cuts
    the lineage of the build)."""
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        writer = builder().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)
