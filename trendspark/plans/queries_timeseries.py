"""Registered time-series queries (WN-*, JN-*, AG-20..22, TK-8, EX-1..2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.operators import timeseries as ts
from trendspark.operators.common import join_keys
from trendspark.plans import frames as FR
from trendspark.plans import panel as P
from trendspark.plans.queries_features import _PATENT_FEATURES_BODY, _RESEARCH_FEATURES_BODY, PAPER_PARAMS, _as_ctes
from trendspark.plans.registry import AS_OF_SQL as ASOF, finish_sql, present, register, with_views

K = ["sector_label"]
TS = "ts"

# ---------------------------------------------------------------------------
# DuckDB building blocks
# ---------------------------------------------------------------------------
_SOURCES = {
    # name: (view, date column, measures)
    "patent": ("patents", "filing_date",
               [("count(*)", "n"), ("count_if(not coalesce(upper(source) in ('USPTO', 'US'), false))", "intl")]),
    "funding": ("funding", "date", [("count(*)", "n"), ("sum(amount_usd)", "amount")]),
    "research": ("papers", "published_date", [("count(*)", "n"), ("sum(citation_count)", "cites")]),
}
_PANELS = {"patent": P.PATENT_PANEL, "funding": P.FUNDING_PANEL, "research": P.RESEARCH_PANEL}


def _mi(c: str) -> str:
    return f"(year({c}) * 12 + month({c}) - 1)"


def panel_ctes(src: str, suffix: str = "") -> str:
    """CTEs ``{src}_m`` (monthly), ``{src}_grid`` (dense) and ``{src}_panel``."""
    view, dcol, measures = _SOURCES[src]
    mcols = [n for _, n in measures]
    measures = ", ".join(f"{e} as {n}" for e, n in measures)
    feats = []
    for f in _PANELS[src]:
        frame = f"over (partition by sector_label order by mi range between {f.months} preceding and 1 preceding)"
        num = f"coalesce(sum({f.num}) {frame}, 0)"
        if f.den is None:
            feats.append(f"{num} / {float(f.months)}::DOUBLE as {f.name}{suffix}")
        else:
            feats.append(f"CAST({num} AS DOUBLE) / nullif(sum({f.den}) {frame}, 0) as {f.name}{suffix}")
    return f"""{src}_m as (
  select sector_label, CAST(date_trunc('month', {dcol}) AS TIMESTAMP) as ts, {measures}
  from {view} group by 1, 2),
{src}_spine as (
  select unnest(generate_series((select CAST(date_trunc('month', min({dcol})) AS TIMESTAMP) from {view}),
                                {ASOF}, INTERVAL 1 MONTH)) as ts),
{src}_grid as (
  select g.sector_label, s.ts, {_mi('s.ts')} as mi, {', '.join(f'coalesce(m.{c}, 0) as {c}' for c in mcols)}
  from (select distinct sector_label from {src}_m) g cross join {src}_spine s
  left join {src}_m m on m.sector_label is not distinct from g.sector_label and m.ts = s.ts),
{src}_panel as (
  select sector_label, ts, {', '.join(feats)} from {src}_grid)"""


def _cols(src: str, suffix: str) -> list[str]:
    return [f.name + suffix for f in _PANELS[src]]


PAT_COLS, FUND_COLS, RES_COLS = _cols("patent", "_patent"), _cols("funding", "_funding"), _cols("research", "_research")
FEATS = PAT_COLS + FUND_COLS + RES_COLS


def _ff(c: str, part: str = "sector_label", order: str = "ts") -> str:
    return (f"coalesce(last_value({c} ignore nulls) over (partition by {part} order by {order} "
            f"rows between unbounded preceding and current row), first_value({c} ignore nulls) over "
            f"(partition by {part} order by {order} rows between current row and unbounded following))")


def aligned_sql_ctes() -> str:
    """CTEs ending in ``aligned`` (WN-13)."""
    pat = panel_ctes("patent", "_patent")
    res = panel_ctes("research", "_research")
    fund = panel_ctes("funding", "_funding")
    tgt = f"""targets as (
  select sector_label, ts, target_growth_6m from (
    select sector_label, ts,
      CAST(lead(n, 6) over (partition by sector_label order by ts) AS DOUBLE) / nullif(n, 0) - 1 as target_growth_6m
    from funding_grid where ts < date_trunc('month', {ASOF})) t
  where target_growth_6m is not null)"""
    merged = f"""merged as (
  select coalesce(pf.sector_label, r.sector_label) as sector_label, coalesce(pf.ts, r.ts) as ts,
         {', '.join(PAT_COLS + FUND_COLS)}, {', '.join(RES_COLS)}
  from (select coalesce(p.sector_label, f.sector_label) as sector_label, coalesce(p.ts, f.ts) as ts,
               {', '.join(PAT_COLS)}, {', '.join(FUND_COLS)}
        from patent_panel p full outer join funding_panel f
          on p.sector_label is not distinct from f.sector_label and p.ts = f.ts) pf
  full outer join research_panel r on pf.sector_label is not distinct from r.sector_label and pf.ts = r.ts),
joined as (
  select m.*, t.target_growth_6m from merged m join targets t
    on m.sector_label is not distinct from t.sector_label and m.ts = t.ts),
aligned as (
  select sector_label, ts, {', '.join(f'{_ff(c)} as {c}' for c in FEATS)}, target_growth_6m from joined)"""
    return with_views(["patents", "funding", "papers"], f"with {pat},\n{fund},\n{res},\n{tgt},\n{merged}")


def training_sql_ctes() -> str:
    z = ", ".join(f"({c} - avg({c}) over (partition by sector_label)) / coalesce(nullif(stddev_pop({c}) over "
                  f"(partition by sector_label), 0), 1) as {c}" for c in FEATS)
    lag_cols = [f"{c}_lag{k}" for c in FEATS for k in P.LAGS]
    lags = ", ".join(f"lag({c}, {k}) over (partition by sector_label order by ts) as {c}_lag{k}"
                     for c in FEATS for k in P.LAGS)
    allc = FEATS + lag_cols
    med = ", ".join(f"coalesce({c}, median({c}) over (partition by sector_label)) as {c}" for c in allc)
    notnull = " and ".join(f"{c} is not null" for c in allc + ["target_growth_6m"])
    return aligned_sql_ctes() + f""",
scaled as (select sector_label, ts, {z}, target_growth_6m from aligned),
lagged as (select *, {lags} from scaled),
imputed as (select sector_label, ts, {med}, target_growth_6m from lagged),
training as (select * from imputed where {notnull})"""


TRAIN_COLS = FEATS + [f"{c}_lag{k}" for c in FEATS for k in P.LAGS]


# ---------------------------------------------------------------------------
# WN-12 month spine
# ---------------------------------------------------------------------------
@register("month_spine", finish_sql(with_views(["funding"], f"""
select unnest(generate_series(
  (select case when date_trunc('month', min(date)) = min(date) then date_trunc('month', min(date))
               else date_trunc('month', min(date)) + INTERVAL 1 MONTH end from funding),
  (select max(date) from funding), INTERVAL 1 MONTH)) as ts"""), ts=("ts",)))
def month_spine(spark, sf):
    f = B.funding(spark, sf)
    bounds = f.agg(F.min("date").alias("s"), F.max("date").alias("e"))
    return present(ts.month_spine(spark, "s", "e", bounds=bounds))


# ---------------------------------------------------------------------------
# AG-22 distinct months, AG-21 monthly first label
# ---------------------------------------------------------------------------
@register("distinct_months", finish_sql(with_views(["patents"], """
select distinct CAST(date_trunc('month', filing_date) AS TIMESTAMP) as month from patents"""), ts=("month",)))
def distinct_months(spark, sf):
    p = B.patents(spark, sf)
    return present(p.select(ts.month_floor("filing_date").alias("month")).distinct().orderBy("month"))


@register("monthly_first", finish_sql(with_views(["patents"], """
select distinct CAST(date_trunc('month', filing_date) AS TIMESTAMP) as month,
       first_value(sector_label ignore nulls) over (partition by date_trunc('month', filing_date)
         order by filing_date, patent_id rows between unbounded preceding and unbounded following) as first_label,
       count(*) over (partition by date_trunc('month', filing_date)) as n_rows
from patents"""), ts=("month",), ints=("n_rows",)))
def monthly_first(spark, sf):
    p = B.patents(spark, sf)
    lab = F.min_by(F.col("sector_label"),
                   F.when(F.col("sector_label").isNotNull(), F.struct("filing_date", "patent_id")))
    return present(p.groupBy(ts.month_floor("filing_date").alias("month"))
                   .agg(lab.alias("first_label"), F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------------------
# EX-1 panels, EX-2 target
# ---------------------------------------------------------------------------
@register("patent_panel", finish_sql(with_views(["patents"], f"with {panel_ctes('patent')}\nselect * from patent_panel"),
                                     ts=("ts",), d6=tuple(f.name for f in P.PATENT_PANEL)))
def patent_panel(spark, sf):
    return present(P.patent_panel(spark, sf))


@register("funding_panel", finish_sql(with_views(["funding"], f"with {panel_ctes('funding')}\nselect * from funding_panel"),
                                      ts=("ts",), d6=("funding_deals_velocity_3m", "funding_deals_velocity_6m",
                                                      "avg_round_size_6m_usd"),
                                      d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd")))
def funding_panel(spark, sf):
    return present(P.funding_panel(spark, sf), d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd"))


@register("research_panel", finish_sql(with_views(["papers"], f"with {panel_ctes('research')}\nselect * from research_panel"),
                                       ts=("ts",), d6=tuple(f.name for f in P.RESEARCH_PANEL)))
def research_panel(spark, sf):
    return present(P.research_panel(spark, sf))


@register("growth_targets", finish_sql(aligned_sql_ctes() + "\nselect * from targets",
                                       ts=("ts",), d6=("target_growth_6m",)))
def growth_targets(spark, sf):
    return present(P.targets(spark, sf))


# ---------------------------------------------------------------------------
# JN-1 outer align, JN-2 join target, WN-2 fill, WN-13 aligned panel
# ---------------------------------------------------------------------------
_MONEY = ("funding_amount_velocity_3m_usd_funding", "funding_amount_velocity_6m_usd_funding")
_FEATS6 = tuple(c for c in FEATS if c not in _MONEY)


@register("outer_align", finish_sql(aligned_sql_ctes() + "\nselect * from merged",
                                    ts=("ts",), d6=_FEATS6, d4=_MONEY))
def outer_align(spark, sf):
    frames = [ts.suffixed(P.patent_panel(spark, sf), K, "_patent"),
              ts.suffixed(P.funding_panel(spark, sf), K, "_funding"),
              ts.suffixed(P.research_panel(spark, sf), K, "_research")]
    return present(ts.outer_align(frames, K), d4=_MONEY)


@register("join_target", finish_sql(aligned_sql_ctes() + "\nselect * from joined",
                                    ts=("ts",), d6=_FEATS6 + ("target_growth_6m",), d4=_MONEY))
def join_target(spark, sf):
    frames = [ts.suffixed(P.patent_panel(spark, sf), K, "_patent"),
              ts.suffixed(P.funding_panel(spark, sf), K, "_funding"),
              ts.suffixed(P.research_panel(spark, sf), K, "_research")]
    return present(join_keys(ts.outer_align(frames, K), P.targets(spark, sf), K + [TS], "inner"), d4=_MONEY)


@register("fill_gaps", finish_sql(aligned_sql_ctes() + f"""
select sector_label, ts, {', '.join(f'{_ff(c)} as {c}' for c in FEATS)}
from merged""", ts=("ts",), d6=_FEATS6, d4=_MONEY))
def fill_gaps(spark, sf):
    frames = [ts.suffixed(P.patent_panel(spark, sf), K, "_patent"),
              ts.suffixed(P.funding_panel(spark, sf), K, "_funding"),
              ts.suffixed(P.research_panel(spark, sf), K, "_research")]
    # the grids start in different years: leading gaps get back-filled
    return present(ts.ffill_bfill(ts.outer_align(frames, K), K, FEATS), d4=_MONEY)


@register("aligned_panel", finish_sql(aligned_sql_ctes() + "\nselect * from aligned",
                                      ts=("ts",), d6=_FEATS6 + ("target_growth_6m",), d4=_MONEY))
def aligned_panel(spark, sf):
    return present(P.aligned_panel(spark, sf), d4=_MONEY)


# ---------------------------------------------------------------------------
# WN-1 lags, WN-3 z-score, WN-4 min-max, WN-5 median impute, WN-7 drop
# ---------------------------------------------------------------------------
_FP = [f.name for f in P.FUNDING_PANEL]
_FP6 = ("funding_deals_velocity_3m", "funding_deals_velocity_6m", "avg_round_size_6m_usd")
_FPM = ("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd")


def _lags(cols) -> tuple[str, ...]:
    return tuple(f"{c}_lag{k}" for c in cols for k in P.LAGS)


@register("lagged_features", finish_sql(with_views(["funding"], f"with {panel_ctes('funding')}\n" + f"""
select *, {', '.join(f'lag({c}, {k}) over (partition by sector_label order by ts) as {c}_lag{k}'
                     for c in _FP for k in P.LAGS)}
from funding_panel"""), ts=("ts",), d6=_FP6 + _lags(_FP6), d4=_FPM + _lags(_FPM)))
def lagged_features(spark, sf):
    return present(ts.lagged(P.funding_panel(spark, sf), K, _FP), d4=_FPM + _lags(_FPM))


@register("zscore_features", finish_sql(with_views(["funding"], f"with {panel_ctes('funding')}\n" + f"""
select sector_label, ts, {', '.join(f'({c} - avg({c}) over (partition by sector_label)) / coalesce(nullif(stddev_pop({c}) over (partition by sector_label), 0), 1) as {c}' for c in _FP)}
from funding_panel"""), ts=("ts",), d6=tuple(_FP)))
def zscore_features(spark, sf):
    return present(ts.zscore(P.funding_panel(spark, sf), K, _FP))


@register("minmax_features", finish_sql(with_views(["funding"], f"with {panel_ctes('funding')}\n" + f"""
select sector_label, ts, {', '.join(f'case when {c} is null then null else coalesce(({c} - min({c}) over (partition by sector_label)) / nullif(max({c}) over (partition by sector_label) - min({c}) over (partition by sector_label), 0), 0) end as {c}' for c in _FP)}
from funding_panel"""), ts=("ts",), d6=tuple(_FP)))
def minmax_features(spark, sf):
    return present(ts.minmax(P.funding_panel(spark, sf), K, _FP))


@register("median_impute", finish_sql(aligned_sql_ctes() + f"""
select sector_label, ts, {', '.join(f'coalesce({c}, median({c}) over (partition by sector_label)) as {c}' for c in FEATS)}
from (select * from merged) m""", ts=("ts",), d6=_FEATS6, d4=_MONEY))
def median_impute(spark, sf):
    frames = [ts.suffixed(P.patent_panel(spark, sf), K, "_patent"),
              ts.suffixed(P.funding_panel(spark, sf), K, "_funding"),
              ts.suffixed(P.research_panel(spark, sf), K, "_research")]
    return present(ts.median_impute(ts.outer_align(frames, K), K, FEATS), d4=_MONEY)


@register("drop_incomplete", finish_sql(aligned_sql_ctes() + f"""
select * from merged where {' and '.join(f'{c} is not null' for c in FEATS)}""",
    ts=("ts",), d6=_FEATS6, d4=_MONEY))
def drop_incomplete(spark, sf):
    frames = [ts.suffixed(P.patent_panel(spark, sf), K, "_patent"),
              ts.suffixed(P.funding_panel(spark, sf), K, "_funding"),
              ts.suffixed(P.research_panel(spark, sf), K, "_research")]
    return present(ts.drop_incomplete(ts.outer_align(frames, K), FEATS, "any"), d4=_MONEY)


# ---------------------------------------------------------------------------
# WN-14 training table
# ---------------------------------------------------------------------------
@register("training_table", finish_sql(training_sql_ctes() + "\nselect * from training",
                                       ts=("ts",), d6=tuple(TRAIN_COLS) + ("target_growth_6m",)))
def training_table(spark, sf):
    return present(P.training_table(spark, sf))


# ---------------------------------------------------------------------------
# WN-8 ntile blocks, WN-9 tail per sector, WN-10 split, WN-11 folds
# ---------------------------------------------------------------------------
# FIXED VALUES: the example sector list spread over the month index.
BLOCK_SECTORS = ("AI", "Biotech", "Energy")


@register("ntile_blocks", finish_sql(with_views(["funding"], f"""
select month, ['AI', 'Biotech', 'Energy'][ntile(3) over (order by month)] as block_label
from (select distinct CAST(date_trunc('month', date) AS TIMESTAMP) as month from funding) m"""), ts=("month",)))
def ntile_blocks(spark, sf):
    from pyspark.sql import Window
    months = B.funding(spark, sf).select(ts.month_floor("date").alias("month")).distinct()
    labels = F.array(*[F.lit(s) for s in BLOCK_SECTORS])
    # months of a calendar: one small partition is the intended plan here
    return present(months.select("month", F.element_at(labels, F.ntile(len(BLOCK_SECTORS))
                                                       .over(Window.orderBy("month"))).alias("block_label")))


@register("tail_per_sector", finish_sql(with_views(["funding"], """
select sector_label, row_key, date, amount_usd from (
  select *, row_number() over (partition by sector_label order by date desc, row_key desc) as rn from funding) t
where rn <= 5"""), ts=("date",), d6=("amount_usd",)))
def tail_per_sector(spark, sf):
    from pyspark.sql import Window
    f = B.funding(spark, sf)
    # rank-limit filter: Spark plans a partial per-partition top-k before the shuffle
    w = Window.partitionBy(*K).orderBy(F.col("date").desc(), F.col("row_key").desc())
    return present(f.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 5)
                   .select(*K, "row_key", "date", "amount_usd"))


@register("train_test_split", finish_sql(aligned_sql_ctes() + """
select sector_label, ts, case when rn <= greatest(1, floor(n * 0.7)) then 'train' else 'test' end as split
from (select sector_label, ts, row_number() over (partition by sector_label order by ts) as rn,
             count(*) over (partition by sector_label) as n from aligned) a""", ts=("ts",)))
def train_test_split(spark, sf):
    return present(ts.chrono_split(P.aligned_panel(spark, sf), K, 0.7).select(*K, TS, "split"))


@register("ts_folds", finish_sql(aligned_sql_ctes() + """
select sector_label, ts, fold, role from (
  select sector_label, ts, fold,
    case when rn <= n - (3 - fold) * (n // 4) then 'train'
         when rn <= n - (3 - fold) * (n // 4) + (n // 4) then 'test' end as role,
    n // 4 as t
  from (select sector_label, ts, row_number() over (partition by sector_label order by ts) as rn,
               count(*) over (partition by sector_label) as n from aligned) a,
       (select unnest([0, 1, 2]) as fold) f) x
where role is not null and t > 0""", ts=("ts",), ints=("fold",)))
def ts_folds(spark, sf):
    return present(ts.expanding_folds(P.aligned_panel(spark, sf), K, 3).select(*K, TS, "fold", "role"))


# ---------------------------------------------------------------------------
# JN-3 as-of, JN-4 left reindex, JN-5 semi join, JN-7 broadcast row
# ---------------------------------------------------------------------------
_ASOF_CTES = f"""spine as (
  select unnest(generate_series((select CAST(date_trunc('month', min(date)) AS TIMESTAMP) from funding),
                                {ASOF}, INTERVAL 1 MONTH)) as ts),
grid as (select g.sector_label, s.ts from (select distinct sector_label from funding) g cross join spine s),
pairs as (
  select g.sector_label, g.ts, f.amount_usd, f.stage,
         row_number() over (partition by g.sector_label, g.ts order by f.date desc, f.row_key desc) as rn
  from grid g join funding f on f.sector_label is not distinct from g.sector_label and f.date <= g.ts),
asof_v as (
  select g.sector_label, g.ts, p.amount_usd, p.stage from grid g
  left join (select * from pairs where rn = 1) p on p.sector_label is not distinct from g.sector_label and p.ts = g.ts)"""
_ASOF_SQL = with_views(["funding"], f"""with {_ASOF_CTES}
select sector_label, ts, {_ff('amount_usd')} as amount_usd, {_ff('stage')} as stage from asof_v""")


@register("asof_features", finish_sql(_ASOF_SQL, ts=("ts",), d6=("amount_usd",)))
def asof_features(spark, sf):
    f = B.funding(spark, sf)
    spine = P._spine_from(f, "date", B.AS_OF)
    return present(ts.asof_monthly(f, K, "date", ["amount_usd", "stage"], spine, tie=["row_key"]))


@register("left_reindex", finish_sql(with_views(["papers"], f"""
with spine as (select unnest(generate_series(TIMESTAMP '1999-07-01 00:00:00', {ASOF}, INTERVAL 1 MONTH)) as ts),
m as (select CAST(date_trunc('month', published_date) AS TIMESTAMP) as ts, count(*) as n_papers,
             avg(citation_count) as avg_citations from papers group by 1)
select s.ts, m.n_papers, m.avg_citations from spine s left join m on m.ts = s.ts"""),
    ts=("ts",), ints=("n_papers",), d6=("avg_citations",)))
def left_reindex(spark, sf):
    import datetime as dt
    r = B.papers(spark, sf)
    spine = ts.month_spine(spark, dt.datetime(1999, 7, 1), B.AS_OF)
    m = r.groupBy(ts.month_floor("published_date").alias(TS)).agg(F.count(F.lit(1)).alias("n_papers"),
                                                                   F.avg("citation_count").alias("avg_citations"))
    return present(spine.join(m, on=TS, how="left"))


@register("semi_recent", finish_sql(with_views(["papers", "patents"], """
select paper_id, sector_label, published_date from papers r
where exists (select 1 from patents p where p.sector_label = r.sector_label
                and date_trunc('month', p.filing_date) = date_trunc('month', r.published_date)
                )"""), ts=("published_date",)))
def semi_recent(spark, sf):
    r = B.papers(spark, sf).withColumn("_m", ts.month_floor("published_date"))
    # distinct keys first: partial aggregation collapses a hot (sector, month)
    # on the map side, so the semi join never ships all of its rows to one task
    p = (B.patents(spark, sf)
         .select("sector_label", ts.month_floor("filing_date").alias("_m")).distinct())
    return present(r.join(p, on=["sector_label", "_m"], how="left_semi").select("paper_id", "sector_label",
                                                                                "published_date"))


_WHOLE_FUNDING = f"""select count_if(date >= {ASOF} - INTERVAL 3 MONTH) / 3::DOUBLE as funding_deals_velocity_3m_funding,
      count_if(date >= {ASOF} - INTERVAL 6 MONTH) / 6::DOUBLE as funding_deals_velocity_6m_funding,
      coalesce(sum(case when date >= {ASOF} - INTERVAL 3 MONTH then amount_usd end), 0) / 3::DOUBLE as funding_amount_velocity_3m_usd_funding,
      coalesce(sum(case when date >= {ASOF} - INTERVAL 6 MONTH then amount_usd end), 0) / 6::DOUBLE as funding_amount_velocity_6m_usd_funding,
      avg(amount_usd) as avg_round_size_usd_funding, median(amount_usd) as median_round_size_usd_funding,
      (select case when max(n) >= 2 and sum(x) <> 0 then sum((2 * i - n - 1) * x) / (max(n) * sum(x)) else 0 end
         from (select amount_usd as x, row_number() over (order by amount_usd) as i, count(*) over () as n
               from funding where amount_usd is not null and amount_usd >= 0) r) as funding_amount_gini_funding,
      case when count_if(stage = 'seed') > 0 then count_if(stage = 'seed') / count(stage)
           else count_if(stage = 'Seed') / count(stage) end as seed_ratio_funding,
      case when count_if(stage = 'series_a') > 0 then count_if(stage = 'series_a') / count(stage)
           else count_if(stage = 'Series A') / count(stage) end as series_a_ratio_funding,
      count_if(stage in ('series_c', 'series_d', 'series_e', 'late_stage_venture', 'Series C', 'Series D', 'Series E'))
        / count(stage) as late_stage_ratio_funding
    from funding"""
_HIST_D2 = ("funding_amount_velocity_3m_usd_funding", "funding_amount_velocity_6m_usd_funding")
_HIST_D6 = ("funding_deals_velocity_3m_funding", "funding_deals_velocity_6m_funding", "avg_round_size_usd_funding",
            "median_round_size_usd_funding", "funding_amount_gini_funding", "seed_ratio_funding",
            "series_a_ratio_funding", "late_stage_ratio_funding")


@register("broadcast_features", finish_sql(with_views(["funding"], f"""
with spine as (select unnest(generate_series(TIMESTAMP '2000-01-01 00:00:00', {ASOF}, INTERVAL 1 MONTH)) as ts),
w as ({_WHOLE_FUNDING})
select spine.ts, w.* from spine cross join w"""), ts=("ts",), d4=_HIST_D2, d6=_HIST_D6))
def broadcast_features(spark, sf):
    import datetime as dt
    from trendspark.operators.features import funding_features
    one = ts.suffixed(funding_features(B.funding(spark, sf), keys=[], as_of=B.AS_OF), [], "_funding")
    spine = ts.month_spine(spark, dt.datetime(2000, 1, 1), B.AS_OF)
    return present(spine.crossJoin(F.broadcast(one)), d4=_HIST_D2)  # one aggregate row: size bounded


# ---------------------------------------------------------------------------
# AG-20 latest non-null per sector, TK-8 first row per sector
# ---------------------------------------------------------------------------
@register("latest_features", finish_sql(aligned_sql_ctes() + f"""
select sector_label, {', '.join(f'arg_max({c}, case when {c} is not null then ts end) as {c}' for c in FEATS)}
from merged group by sector_label""", d6=_FEATS6, d4=_MONEY))
def latest_features(spark, sf):
    frames = [ts.suffixed(P.patent_panel(spark, sf), K, "_patent"),
              ts.suffixed(P.funding_panel(spark, sf), K, "_funding"),
              ts.suffixed(P.research_panel(spark, sf), K, "_research")]
    return present(ts.latest_non_null(ts.outer_align(frames, K), K, FEATS), d4=_MONEY)


@register("first_row_per_sector", finish_sql(aligned_sql_ctes() + """
select * exclude (rn) from (
  select *, row_number() over (partition by sector_label order by ts) as rn from aligned) a where rn = 1""",
    ts=("ts",), d6=_FEATS6 + ("target_growth_6m",), d4=_MONEY))
def first_row_per_sector(spark, sf):
    return present(ts.first_row(P.aligned_panel(spark, sf), K, [TS]), d4=_MONEY)


# ---------------------------------------------------------------------------
# WN-6 constant fill of text gaps on the month index
# ---------------------------------------------------------------------------
@register("fill_unknown", finish_sql(with_views(["papers"], f"""
with spine as (select unnest(generate_series(TIMESTAMP '1999-01-01 00:00:00', {ASOF}, INTERVAL 1 MONTH)) as ts),
firsts as (select distinct CAST(date_trunc('month', published_date) AS TIMESTAMP) as ts,
             first_value(sector_label) over (partition by date_trunc('month', published_date)
               order by published_date, paper_id rows between unbounded preceding and unbounded following) as label
           from papers)
select s.ts, coalesce(last_value(f.label ignore nulls) over (order by s.ts rows between unbounded preceding and current row),
                      'DefaultSector') as sector_label
from spine s left join firsts f on f.ts = s.ts"""), ts=("ts",)))
def fill_unknown(spark, sf):
    import datetime as dt
    from pyspark.sql import Window
    r = B.papers(spark, sf)
    firsts = r.groupBy(ts.month_floor("published_date").alias(TS)).agg(
        F.min_by("sector_label", F.struct("published_date", "paper_id")).alias("label"))
    spine = ts.month_spine(spark, dt.datetime(1999, 1, 1), B.AS_OF)
    # month index of a calendar: a single small window partition is intended
    w = Window.orderBy(TS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spine.join(firsts, on=TS, how="left").select(
        TS, F.last("label", ignorenulls=True).over(w).alias("sector_label"))
    return present(out.fillna("DefaultSector", subset=["sector_label"]))


# ---------------------------------------------------------------------------
# WN-15 history table
# ---------------------------------------------------------------------------
_WHOLE_PATENT = ("filing_rate_3m", "filing_rate_6m", "filing_rate_12m", "tech_diversity_shannon", "unique_inventor_count",
                 "citation_velocity_avg", "forward_citation_rate_avg", "international_filing_ratio")
_WHOLE_RESEARCH = ("publication_rate_3m", "publication_rate_6m", "avg_citation_count", "avg_authors_per_paper",
                   "category_diversity_shannon", "avg_abstract_length", "avg_keyword_count", "sum_keyword_count")
_HIST_MORE = tuple([f"{c}_patent" for c in _WHOLE_PATENT] + [f"{c}_research" for c in _WHOLE_RESEARCH])  # counts too: an imputed column is a double


def _history_sql() -> str:
    return with_views(["funding", "patents", "papers"], f"""with {_ASOF_CTES},
lr as (select sector_label, ts, {_ff('amount_usd')} as last_round_usd, {_ff('stage')} as last_stage from asof_v),
tgt as (
  select sector_label, ts, target_growth_6m from (
    select sector_label, ts,
      CAST(lead(n, 6) over (partition by sector_label order by ts) AS DOUBLE) / nullif(n, 0) - 1 as target_growth_6m
    from (select g.sector_label, s.ts, coalesce(m.n, 0) as n
          from (select distinct sector_label from funding) g cross join spine s
          left join (select sector_label, CAST(date_trunc('month', date) AS TIMESTAMP) as ts, count(*) as n
                     from funding group by 1, 2) m
            on m.sector_label is not distinct from g.sector_label and m.ts = s.ts
          where s.ts < date_trunc('month', {ASOF})) x) t
  where target_growth_6m is not null),
whole_funding as ({_WHOLE_FUNDING}),
one_patents as (select * replace (0 as sector_label) from patents),
{_as_ctes(_PATENT_FEATURES_BODY.replace('from patents', 'from one_patents'), "wp")},
one_papers as (select * replace (0 as sector_label) from papers),
{_as_ctes(_RESEARCH_FEATURES_BODY.replace('from papers', 'from one_papers'), "wr")},
whole as (
  select {', '.join(f'wp.{c} as {c}_patent' for c in _WHOLE_PATENT)}, whole_funding.*, {', '.join(f'wr.{c} as {c}_research' for c in _WHOLE_RESEARCH)}
  from whole_funding cross join wp cross join wr),
hist as (
  select t.sector_label, t.ts, t.target_growth_6m, l.last_round_usd, coalesce(l.last_stage, 'Unknown') as last_stage, w.*
  from tgt t left join lr l on l.sector_label is not distinct from t.sector_label and l.ts = t.ts cross join whole w)
select sector_label, ts, target_growth_6m,
       coalesce(last_round_usd, median(last_round_usd) over (partition by sector_label)) as last_round_usd,
       last_stage, * exclude (sector_label, ts, target_growth_6m, last_round_usd, last_stage)
from hist""")



@register("history_table", finish_sql(_history_sql(),
                                      ts=("ts",), d4=_HIST_D2,
                                      d6=("target_growth_6m", "last_round_usd") + _HIST_D6 + _HIST_MORE))
def history_table(spark, sf):
    return present(P.history_table(spark, sf, params=PAPER_PARAMS), d4=_HIST_D2)


# ---------------------------------------------------------------------------
# EX-3 scaler fitted on the training split only
# ---------------------------------------------------------------------------
@register("zscore_train_fit", finish_sql(with_views(["funding"], f"with {panel_ctes('funding')},\n" + f"""
split as (select *, case when row_number() over (partition by sector_label order by ts)
                           <= greatest(1, floor(count(*) over (partition by sector_label) * 0.7)) then 'train' else 'test' end as split
          from funding_panel)
select sector_label, ts, split, {', '.join(
    f"({c} - avg(case when split = 'train' then {c} end) over (partition by sector_label)) / coalesce(nullif(stddev_pop(case when split = 'train' then {c} end) over (partition by sector_label), 0), 1) as {c}"
    for c in _FP)}
from split"""), ts=("ts",), d6=tuple(_FP)))
def zscore_train_fit(spark, sf):
    sp = ts.chrono_split(P.funding_panel(spark, sf), K, 0.7)
    return present(ts.zscore(sp, K, _FP, fit_on=F.col("split") == "train").select(*K, TS, "split", *_FP))


# ---------------------------------------------------------------------------
# PRJ-7, WN-13, WN-14 on frames as a caller has them
# ---------------------------------------------------------------------------
def _caller_frames(spark, sf):
    """The panels with the date columns of their records, one of them as text,
    and a target frame."""
    return (P.patent_panel(spark, sf).withColumn("filing_date", F.col(TS).cast("string")).drop(TS),
            P.funding_panel(spark, sf).withColumnRenamed(TS, "date"),
            P.research_panel(spark, sf).withColumnRenamed(TS, "published_date"))


@register("frames_aligned", finish_sql(aligned_sql_ctes() + "\nselect * rename (target_growth_6m as growth) from aligned",
                                       ts=("ts",), d6=_FEATS6 + ("growth",), d4=_MONEY))
def frames_aligned(spark, sf):
    """The target's first column, since none has the usual name."""
    targets = P.targets(spark, sf).select(*K, F.col("target_growth_6m").alias("growth"), F.col(TS).alias("timestamp"))
    return present(FR.align(*_caller_frames(spark, sf), targets, K), d4=_MONEY)


def _fitted_sql() -> str:
    train = "filter (where split = 'train') over (partition by sector_label)"
    z = ", ".join(f"({c} - avg({c}) {train}) / coalesce(nullif(stddev_pop({c}) {train}, 0), 1) as {c}" for c in FEATS)
    lags = ", ".join(f"lag({c}, {k}) over (partition by sector_label order by ts) as {c}_lag{k}" for c in FEATS for k in P.LAGS)
    med = ", ".join(f"coalesce({c}, median({c}) {train}) as {c}" for c in TRAIN_COLS)
    return aligned_sql_ctes() + f""",
split as (
  select * exclude (rn, n), case when rn <= greatest(1, floor(n * 0.7)) then 'train' else 'test' end as split
  from (select *, row_number() over (partition by sector_label order by ts) as rn, count(*) over (partition by sector_label) as n from aligned) a),
scaled as (select sector_label, ts, split, {z}, target_growth_6m from split),
lagged as (select *, {lags} from scaled),
imputed as (select sector_label, ts, {med}, target_growth_6m from lagged)
select * from imputed where {' and '.join(f'{c} is not null' for c in TRAIN_COLS)}"""


@register("frames_training", finish_sql(_fitted_sql(), ts=("ts",), d6=tuple(TRAIN_COLS) + ("target_growth_6m",)))
def frames_training(spark, sf):
    """Means, spreads and medians of each sector's first 70% alone."""
    data = FR.prepare_training(*_caller_frames(spark, sf), P.targets(spark, sf), K, P.LAGS, 0.7)
    return present(data.rows)
