"""Bindings of the record sets on the driver's tables.

The jobs work on three raw record sets (patents, funding rounds, papers) and
a pipeline status log. On the test tables they are derived views:

* funding   = orders ⋈ customer (sector = market segment, stage from priority)
* patents   = lineitem ⋈ part ⋈ supplier ⋈ orders ⋈ customer
* papers    = documents (sector from doc_id)
* status_log= events (pipeline name from event type)

All builders are lazy DataFrames; join strategy is left to Catalyst/AQE,
which broadcasts a side only when its measured size is under the threshold.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.operators.common import ts_lit  # noqa: F401  (re-exported for query modules)
from trendspark.sources.scan import read_table

# FIXED VALUES: the "now" of the record sets and of the status log.
AS_OF = dt.datetime(2001, 8, 2, 0, 0, 0)
STATUS_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)

# FIXED VALUES: document → sector mapping of the papers view (doc_id % 5).
PAPER_SECTORS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    stage = (F.when(F.col("o_orderpriority") == "1-URGENT", "seed")
             .when(F.col("o_orderpriority") == "2-HIGH", "series_a")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "series_b")
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "series_c")
             .otherwise("series_d"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_custkey").cast("string").alias("company_uuid"),
                    F.col("c_name").alias("company_name"),
                    F.col("o_totalprice").alias("amount_usd"),
                    F.lit("USD").alias("currency"),
                    F.col("o_orderdate").alias("date"),
                    stage.alias("stage"),
                    F.lit("orders").alias("source"),
                    F.col("c_mktsegment").alias("sector_label"),
                    F.col("o_orderkey").alias("row_key")))


def patent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patents with the order their line is of. Orders meet customers
    before lines, so that the lines are dealt by order last of all: a grouping
    by ``order_key`` finds them together."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    source = (F.when(F.col("l_returnflag") == "N", "USPTO")
              .when(F.col("l_returnflag") == "A", "EPO").otherwise("WIPO"))
    return (li.join(p, li.l_partkey == p.p_partkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
            .select(F.col("l_orderkey").alias("order_key"),
                    F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("patent_id"),
                    F.col("p_name").alias("title"),
                    F.col("l_shipdate").alias("filing_date"),
                    F.col("s_name").alias("assignee"),
                    F.array(F.col("s_name"),
                            F.concat(F.lit("Inventor#"), (F.col("l_partkey") % 97).cast("string"))).alias("inventors"),
                    F.col("p_brand").alias("tech_class"),
                    F.col("l_quantity").cast("int").alias("citations"),
                    F.col("l_linenumber").alias("forward_citations"),
                    source.alias("source"),
                    F.col("c_mktsegment").alias("sector_label")))


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patent_lines(spark, sf_dir).drop("order_key")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    sector = F.element_at(F.array(*[F.lit(s) for s in PAPER_SECTORS]), (doc % 5 + 1).cast("int"))
    first_author = F.concat(F.coalesce("lang", F.lit("")), F.lit("-"), (doc % 7).cast("string"))
    second_author = F.concat(F.coalesce("source", F.lit("")), F.lit("-"), (doc % 11).cast("string"))
    return d.select(
        doc.cast("string").alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(doc % 3 == 0, F.array(first_author)).otherwise(F.array(first_author, second_author)).alias("authors"),
        F.col("text").alias("abstract"),
        F.array(F.col("lang"), F.col("source")).alias("categories"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (doc * 7 % 580).cast("int")).cast("timestamp_ntz").alias("published_date"),
        F.concat(F.lit("http://example.com/"), doc.cast("string")).alias("pdf_url"),
        (doc % 13).cast("int").alias("citation_count"),
        F.when(doc % 2 == 0, "feed_a").otherwise("feed_b").alias("source"),
        sector.alias("sector_label"),
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = (F.when(F.col("event_type") == "click", "patents_pipeline")
            .when(F.col("event_type") == "view", "funding_pipeline")
            .when(F.col("event_type") == "purchase", "research_pipeline")
            .otherwise("main_run"))
    return e.select(name.alias("pipeline_name"),
                    F.col("ts").alias("last_run_timestamp"),
                    F.when(F.col("value") >= 20, "SUCCESS").otherwise("FAILED").alias("status"),
                    F.col("props").alias("details"),
                    F.col("event_id").alias("row_key"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market size per sector = total funding amount (one row per sector)."""
    return (funding(spark, sf_dir).groupBy("sector_label")
            .agg(F.sum("amount_usd").alias("market_size_usd")))
