"""Registry of named queries and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle is ANSI SQL that
DuckDB runs over the same Parquet tables (registered as views). Both sides
finish the same way: doubles rounded as ``round(x·10^p)/10^p`` in double
arithmetic (p = 6; 4 for money sums), so both engines round the identical
IEEE product, ties included; timestamps
as ``yyyy-MM-dd HH:mm:ss`` text, lists joined with ``|``, integers as bigint,
so the comparison is exact.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def present(df: DataFrame, d4: tuple[str, ...] = (), d0: tuple[str, ...] = ()) -> DataFrame:
    """Spark-side finish: see module doc."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            places = 4 if f.name in d4 else (0 if f.name in d0 else 6)
            scale = float(10 ** places)
            c = F.round(c.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def finish_sql(sql: str, d6: tuple[str, ...] = (), d4: tuple[str, ...] = (), d0: tuple[str, ...] = (),
               ints: tuple[str, ...] = (), ts: tuple[str, ...] = (), dates: tuple[str, ...] = (),
               arrays: tuple[str, ...] = ()) -> str:
    """DuckDB-side finish matching ``present``."""
    def rnd(c: str, places: int) -> str:
        scale = f"{float(10 ** places)}::DOUBLE"
        return f"round(CAST({c} AS DOUBLE) * {scale}) / {scale} + 0.0 AS {c}"
    repl = ([rnd(c, 6) for c in d6] + [rnd(c, 4) for c in d4] + [rnd(c, 0) for c in d0]
            + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
            + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in ts]
            + [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
            + [f"array_to_string({c}, '|') AS {c}" for c in arrays])
    if not repl:
        return sql
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS q"


# ---------------------------------------------------------------------------
# Oracle-side bindings (DuckDB dialect) of the views in trendspark.bindings.
# ---------------------------------------------------------------------------
AS_OF_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
STATUS_AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

DUCK_VIEWS: dict[str, str] = {
    "funding": """
select cast(o_custkey as varchar) company_uuid, c_name company_name,
       o_totalprice amount_usd, 'USD' currency, o_orderdate as date,
       case o_orderpriority when '1-URGENT' then 'seed' when '2-HIGH' then 'series_a'
            when '3-MEDIUM' then 'series_b' when '4-NOT SPECIFIED' then 'series_c'
            else 'series_d' end stage,
       'orders' source, c_mktsegment sector_label, o_orderkey row_key
from orders join customer on o_custkey = c_custkey""",
    "patents": """
select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
                 cast(l_partkey as varchar), cast(l_suppkey as varchar)) patent_id,
       p_name title, l_shipdate filing_date, s_name assignee,
       list_value(s_name, concat('Inventor#', cast(l_partkey % 97 as varchar))) inventors,
       p_brand tech_class, cast(l_quantity as int) citations,
       l_linenumber forward_citations,
       case l_returnflag when 'N' then 'USPTO' when 'A' then 'EPO' else 'WIPO' end source,
       c_mktsegment sector_label
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
     join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
    "papers": """
select cast(doc_id as varchar) paper_id, split_part(text, chr(10), 1) title,
       case when doc_id % 3 = 0
            then list_value(concat(lang,'-',cast(doc_id % 7 as varchar)))
            else list_value(concat(lang,'-',cast(doc_id % 7 as varchar)),
                       concat(source,'-',cast(doc_id % 11 as varchar))) end authors,
       text abstract, list_value(lang, source) categories,
       cast(date '2000-01-01' + cast(doc_id*7 % 580 as int) as timestamp) published_date,
       concat('http://example.com/', cast(doc_id as varchar)) pdf_url,
       cast(doc_id % 13 as int) citation_count,
       case when doc_id % 2 = 0 then 'feed_a' else 'feed_b' end source,
       case doc_id % 5 when 0 then 'AUTOMOBILE' when 1 then 'BUILDING'
            when 2 then 'FURNITURE' when 3 then 'HOUSEHOLD' else 'MACHINERY' end sector_label
from documents""",
    "status_log": """
select case event_type when 'click' then 'patents_pipeline' when 'view' then 'funding_pipeline'
            when 'purchase' then 'research_pipeline' else 'main_run' end pipeline_name,
       ts last_run_timestamp, case when value >= 20 then 'SUCCESS' else 'FAILED' end status,
       props details, event_id row_key
from events""",
    "market": """
select c_mktsegment sector_label, sum(o_totalprice) market_size_usd
from orders join customer on o_custkey = c_custkey group by 1""",
}
_VIEW_DEPS: dict[str, tuple[str, ...]] = {}


def with_views(names: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix ``body`` with CTEs for the named views (dependencies first)."""
    import re
    defined = {n for n in DUCK_VIEWS if re.search(rf"(?i)(?:^\s*with|,)\s*{n}\s+as\s*\(", body)}
    ordered: list[str] = []
    for n in names:
        for dep in _VIEW_DEPS.get(n, ()):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    ordered = [n for n in ordered if n not in defined]
    body = body.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in ordered)
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
