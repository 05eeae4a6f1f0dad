"""Registered queries of refreshed monthly states (SRC-2, EX-1) and of the
segmented scan on raw rows (JN-3, WN-1, WN-2)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.operators import segmented as S
from trendspark.plans import incremental as I
from trendspark.plans import panel as P
from trendspark.plans.queries_timeseries import panel_ctes
from trendspark.plans.registry import finish_sql, present, register, with_views
from trendspark.session import ensure_checkpoint_dir

K = ["sector_label"]
SPEC = I.MonthlySpec(("sector_label", "stage"), "date", (("n", "count(*)"), ("amount", "sum(amount_usd)")))


def _refreshed(spark, sf) -> I.MonthlyStates:
    """Funding records landed as files, most of them before a first refresh
    and the rest, of the last months and of some earlier ones, before a second."""
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trendspark-incremental/{uuid.uuid4().hex}"
    f = B.funding(spark, sf).select(*K, "stage", "date", "amount_usd", "row_key")
    late = (F.col("date") >= F.lit("2000-06-01").cast("timestamp_ntz")) | ((F.col("row_key") % 50 == 0) & (F.month("date") == 3))
    f.where(~F.coalesce(late, F.lit(False))).write.parquet(f"{home}/in/first")
    states = I.MonthlyStates(spark, f"{home}/in", f"{home}/states", SPEC, f.schema)
    states.refresh()
    f.where(F.coalesce(late, F.lit(False))).write.parquet(f"{home}/in/second")
    states.refresh()
    return states


@register("incremental_monthly", finish_sql(with_views(["funding"], """
select CAST(date_trunc('month', date) AS DATE) as month, sector_label, stage, count(*) as n, sum(amount_usd) as amount
from funding where date is not null group by 1, 2, 3"""), dates=("month",), ints=("n",), d4=("amount",)))
def incremental_monthly(spark, sf):
    return present(_refreshed(spark, sf).monthly(), d4=("amount",))


@register("incremental_panel", finish_sql(with_views(["funding"], f"with {panel_ctes('funding')}\nselect * from funding_panel"),
                                          ts=("ts",), d6=("funding_deals_velocity_3m", "funding_deals_velocity_6m", "avg_round_size_6m_usd"),
                                          d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd")))
def incremental_panel(spark, sf):
    """EX-1's funding panel from the refreshed table instead of the records."""
    panel = I.trailing_from(_refreshed(spark, sf).monthly(), K, B.AS_OF, P.FUNDING_PANEL)
    return present(panel, d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd"))


@register("raw_asof", finish_sql(with_views(["patents", "funding"], """
with rounds as (
  select coalesce(sector_label, chr(0)) k, date, max(row_key) last_round, arg_max(amount_usd, row_key) last_round_usd
  from funding where date is not null group by 1, 2)
select p.patent_id, p.sector_label, p.filing_date, r.last_round, r.last_round_usd
from patents p asof left join rounds r on coalesce(p.sector_label, chr(0)) = r.k and p.filing_date >= r.date"""),
    ts=("filing_date",), ints=("last_round",), d6=("last_round_usd",)))
def raw_asof(spark, sf):
    """JN-3 on raw rows: each patent with its sector's latest funding round."""
    patents = B.patents(spark, sf).select("patent_id", *K, "filing_date")
    rounds = B.funding(spark, sf).select(*K, "date", F.col("row_key").alias("last_round"), F.col("amount_usd").alias("last_round_usd"))
    return present(S.as_of(patents, rounds, K, "filing_date", "date", ["last_round", "last_round_usd"], ["last_round"]))


@register("raw_fill_lag", finish_sql("""
with e as (select event_id, event_type, ts, case when value >= 20 then value end as value from events),
f as (
  select event_id, event_type, ts, coalesce(
      last_value(value ignore nulls) over (partition by event_type order by ts, event_id rows between unbounded preceding and current row),
      first_value(value ignore nulls) over (partition by event_type order by ts, event_id rows between current row and unbounded following)) as value
  from e)
select *, lag(value, 1) over w as value_lag1, lag(value, 12) over w as value_lag12 from f
window w as (partition by event_type order by ts, event_id)""", ts=("ts",), d6=("value", "value_lag1", "value_lag12")))
def raw_fill_lag(spark, sf):
    """WN-1 and WN-2 on raw events at their own times."""
    e = B.table(spark, sf, "events").select("event_id", "event_type", "ts", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    filled = S.fill(e, ["event_type"], ["ts", "event_id"], ["value"], True, True)
    return present(S.lag(filled, ["event_type"], ["ts", "event_id"], ["value"], (1, 12)))
