"""Session helpers.

Jobs take the caller's SparkSession. ``local_session`` exists for tests and
the bench; on a cluster the submitter configures the session.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster names in
    ``spark.checkpoint.dir``. Where nothing is configured, a local master
    (tests) gets a fresh folder under /tmp; a cluster has no folder that all
    its executors see, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trendspark-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package wherever their Python starts: the
    driver serves it to them as a zip file, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_trendspark_shipped", False):
        return
    import shutil
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="trendspark-zip-"), "trendspark")
    sc.addPyFile(shutil.make_archive(at, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._trendspark_shipped = True


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "trendspark") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def materialize_files(df, name: str) -> str:
    """Write a table into the cluster's checkpoint folder; its path."""
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/trendspark-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df, name: str):
    """Cut lineage with a written table in the cluster's checkpoint folder
    and read it back. Used for wide frames, where ``checkpoint()`` would carry
    the source plan's (large) constraint set into the new relation."""
    return df.sparkSession.read.parquet(materialize_files(df, name))
