"""Fixed schemas of the record sets, schema conforming (SRC-3) and sinks (SNK-1)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATENT_SCHEMA = T.StructType([
    T.StructField("patent_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("filing_date", T.TimestampNTZType()), T.StructField("assignee", T.StringType()),
    T.StructField("inventors", T.ArrayType(T.StringType())), T.StructField("tech_class", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("citations", T.IntegerType()),
    T.StructField("forward_citations", T.IntegerType()),
    T.StructField("source", T.StringType()), T.StructField("sector_label", T.StringType()),
])
FUNDING_SCHEMA = T.StructType([
    T.StructField("company_uuid", T.StringType()), T.StructField("company_name", T.StringType()),
    T.StructField("amount_usd", T.DoubleType()), T.StructField("currency", T.StringType()),
    T.StructField("date", T.TimestampNTZType()), T.StructField("stage", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("sector_label", T.StringType()),
])
PAPER_SCHEMA = T.StructType([
    T.StructField("paper_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("abstract", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("published_date", T.TimestampNTZType()),
    T.StructField("pdf_url", T.StringType()), T.StructField("citation_count", T.IntegerType()),
    T.StructField("source", T.StringType()), T.StructField("sector_label", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None,
            date_formats: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rename (only when the target is absent), parse text dates with the
    given pattern, cast to the schema, add missing columns as typed nulls
    (or a default), and drop columns outside the schema."""
    for src, dst in (renames or {}).items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if date_formats and f.name in date_formats and isinstance(df.schema[f.name].dataType, T.StringType):
                c = F.try_to_timestamp(c, F.lit(date_formats[f.name]))
            c = c.cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if defaults and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed empty frame (nothing loaded)."""
    return spark.createDataFrame([], schema)


def write_if_any(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """SNK-1: overwrite the Parquet at ``path`` unless there is no row. The
    rows are computed once: they are written beside ``path``, counted by the
    write itself, and take its place if there are any."""
    import uuid

    beside, seen = f"{path.rstrip('/')}-{uuid.uuid4().hex}", Observation("written rows")
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(beside)
    some = seen.get["n"] > 0
    jvm = df.sparkSession.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    fs = new.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if some:
        fs.delete(old, True)
        fs.rename(new, old)
    else:
        fs.delete(new, True)
    return some
