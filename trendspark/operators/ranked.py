"""Exact order statistics without collecting a group into one task.

``value_ranks`` gives, for every distinct (group, value), its count ``c`` and
the number of smaller values in the group ``before``. It works for a group
holding a third of all rows:

1. ties collapse first (``groupBy(keys, x).count()``, partial aggregation
   on the map side), so a hot single value is one row;
2. the collapsed rows are range-partitioned on (keys, x) — each partition is
   a contiguous, bounded slice of the order — and checkpointed so partition
   ids stay fixed;
3. per-partition totals (tiny: partitions + groups rows) give each slice its
   offset; a window inside each (slice, group) gives the local prefix.

Exact median and Gini are then plain aggregates over this table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.session import ensure_checkpoint_dir


def value_ranks(df: DataFrame, keys: list[str], value: Column | str,
                partitions: int | None = None) -> DataFrame:
    """(keys..., x, c, before, n): distinct non-null values per group with
    their count, the count of smaller values and the group size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    v = F.col(value) if isinstance(value, str) else value
    # one non-null group key: struct equality treats null fields as equal, so
    # a plain equi-join on it can reuse the window's hash partitioning
    gk = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    collapsed = (df.where(v.isNotNull())
                 .groupBy(*keys, v.cast("double").alias("x"))
                 .agg(F.count(F.lit(1)).alias("c"))
                 .withColumn("_gk", gk))
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (collapsed.repartitionByRange(n_parts, *keys, "x")
              .withColumn("pid", F.spark_partition_id())
              .checkpoint(eager=True))
    slices = ranged.groupBy("pid", "_gk").agg(F.sum("c").alias("pc"))
    by_key = Window.partitionBy("_gk")
    slices = slices.select(
        "pid", "_gk",
        F.coalesce(F.sum("pc").over(by_key.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("offset"),
        F.sum("pc").over(by_key).alias("n"))
    local = Window.partitionBy("pid", "_gk").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("local_before", F.coalesce(F.sum("c").over(local), F.lit(0)))
    out = ranked.join(slices, on=["pid", "_gk"], how="inner")
    return out.select(*keys, "x", "c", (F.col("offset") + F.col("local_before")).alias("before"), "n")


def exact_median(ranks: DataFrame, keys: list[str], name: str = "median") -> DataFrame:
    """Interpolated median (mean of the two middle values) per group."""
    k_lo = F.floor((F.col("n") - 1) / 2)
    k_hi = F.ceil((F.col("n") - 1) / 2)
    lo = F.max(F.when(F.col("before") <= k_lo, F.col("x")))
    hi = F.max(F.when(F.col("before") <= k_hi, F.col("x")))
    return ranks.groupBy(*keys).agg(((lo + hi) / 2.0).alias(name))


def gini(ranks: DataFrame, keys: list[str], name: str = "gini") -> DataFrame:
    """Gini over the non-negative values of each group:
    Σ(2i − n − 1)·x / (n·Σx) with i the ascending rank; fewer than 2 values
    or a zero sum → 0. Ties share the closed form
    x·(c(2e − c + 1) − c(n + 1)) with e the inclusive running count."""
    nonneg = F.col("x") >= 0
    e = F.col("before") + F.col("c")
    a = F.sum(F.when(nonneg, F.col("x") * F.col("c") * (2 * e - F.col("c") + 1)))
    s = F.sum(F.when(nonneg, F.col("c") * F.col("x")))
    n_neg = F.coalesce(F.sum(F.when(~nonneg, F.col("c"))), F.lit(0))
    n_pos = F.coalesce(F.sum(F.when(nonneg, F.col("c"))), F.lit(0))
    agg = ranks.groupBy(*keys).agg(a.alias("_a"), s.alias("_s"), n_neg.alias("_nn"), n_pos.alias("_np"))
    num = F.col("_a") - 2 * F.col("_nn") * F.col("_s") - (F.col("_np") + 1) * F.col("_s")
    g = F.when((F.col("_np") >= 2) & (F.col("_s") != 0), num / (F.col("_np") * F.col("_s"))).otherwise(F.lit(0.0))
    return agg.select(*keys, g.alias(name))
