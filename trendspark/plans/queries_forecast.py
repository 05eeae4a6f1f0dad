"""Registered forecast, emergence, opportunity, uncertainty and monitoring
queries (FC-*, ML-5, ML-6, AG-23, EM-*, IV-*, TK-*, UN-*, MO-*, JN-8/9, FLT-11/12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.operators import forecast as fc
from trendspark.operators import monitor as mo
from trendspark.operators import opportunities as iv
from trendspark.operators import timeseries as ts
from trendspark.operators import uncertainty as un
from trendspark.operators.common import join_keys
from trendspark.operators.features import funding_features, patent_features, research_features
from trendspark.params import EmergenceParams, IndexWeights, InvestmentParams, MonitorParams
from trendspark.plans import forecasting as FC
from trendspark.plans import panel as P
from trendspark.plans.queries_timeseries import FEATS, aligned_sql_ctes
from trendspark.plans.registry import STATUS_AS_OF_SQL, finish_sql, present, register, with_views

K = ["sector_label"]
EP = EmergenceParams()
IP = InvestmentParams()
MP = MonitorParams()

# ---------------------------------------------------------------------------
# SQL chain on top of the aligned panel
# ---------------------------------------------------------------------------
_Q = []
for lv in (0.68, 0.95):
    a = 1.0 - lv
    _Q += [a / 2.0, 1.0 - a / 2.0]
_QLIST = "[" + ", ".join(repr(q) for q in _Q) + "]"
_W = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in FC.TREND_WEIGHTS.items())


def _fit(src: str) -> str:
    return f"""select sector_label, regr_slope(target_growth_6m, mi) as slope,
         regr_intercept(target_growth_6m, mi) as intercept, avg(target_growth_6m) as mean_v,
         arg_max(target_growth_6m, ts) as last_v, max(mi) as last_mi
  from (select *, CAST(year(ts) * 12 + month(ts) - 1 AS DOUBLE) as mi from {src}) x group by sector_label"""


FC_CTES = aligned_sql_ctes() + f""",
split as (
  select * exclude (rn, n), case when rn <= greatest(1, floor(n * 0.7)) then 'train' else 'test' end as split
  from (select *, row_number() over (partition by sector_label order by ts) as rn,
               count(*) over (partition by sector_label) as n from aligned) a),
fit_all as ({_fit('aligned')}),
cur_preds as (
  select sector_label, 'linear_trend' as model, intercept + slope * (last_mi + 1) as prediction from fit_all
  union all select sector_label, 'train_mean', mean_v from fit_all
  union all select sector_label, 'last_value', last_v from fit_all),
fit_train as ({_fit("(select * from split where split = 'train')")}),
test_rows as (select * from split where split = 'test'),
val_preds as (
  select t.sector_label, t.ts, m.model, m.prediction from (
    select t.sector_label, t.ts, f.intercept + f.slope * CAST(year(t.ts) * 12 + month(t.ts) - 1 AS DOUBLE) as p1,
           f.mean_v as p2, f.last_v as p3
    from test_rows t join fit_train f on f.sector_label is not distinct from t.sector_label) t,
  lateral (select * from (values ('linear_trend', t.p1), ('train_mean', t.p2), ('last_value', t.p3)) v(model, prediction)) m),
metrics as (
  select p.sector_label, p.model, avg(abs(p.prediction - t.target_growth_6m)) as mae,
         sqrt(avg((p.prediction - t.target_growth_6m) * (p.prediction - t.target_growth_6m))) as rmse,
         avg(case when sign(coalesce(t.target_growth_6m, 0)) = sign(coalesce(p.prediction, 0)) then 1.0 else 0.0 end) as direction_accuracy,
         count(*) as n_test
  from val_preds p join test_rows t on t.sector_label is not distinct from p.sector_label and t.ts = p.ts
  group by 1, 2),
weights as (select * from (values {_W}) w(model, weight)),
ens as (
  select p.sector_label,
    case when coalesce(sum(case when p.prediction is not null and w.weight is not null then w.weight end), 0) <> 0
         then sum(case when p.prediction is not null and w.weight is not null then w.weight * p.prediction end)
              / sum(case when p.prediction is not null and w.weight is not null then w.weight end)
         else avg(p.prediction) end as prediction,
    count(p.prediction) as n_models
  from cur_preds p left join weights w on w.model = p.model group by 1),
ci_raw as (select sector_label, count(*) as n, quantile_cont(prediction, {_QLIST}) as q
           from cur_preds where prediction is not null group by 1),
ci as (select sector_label,
         case when n >= 2 then q[1] end as ci68_low, case when n >= 2 then q[2] end as ci68_high,
         case when n >= 2 then q[3] end as ci95_low, case when n >= 2 then q[4] end as ci95_high from ci_raw),
forecasts as (
  select e.sector_label, h.horizon_pos, h.horizon_months, concat(CAST(h.horizon_months AS VARCHAR), 'm_growth_rate') as horizon_key,
         e.prediction, c.ci68_low, c.ci68_high, c.ci95_low, c.ci95_high, 0.75::DOUBLE as quality_score,
         TIMESTAMP '2001-08-02 00:00:00' as generated_at
  from ens e left join ci c on c.sector_label is not distinct from e.sector_label
  cross join (values (0, 6), (1, 12), (2, 18)) h(horizon_pos, horizon_months)
  where e.prediction is not null),
summary as (
  select * exclude (rk) from (
    select *, row_number() over (partition by sector_label
                                 order by case when horizon_months = 12 then -1 else horizon_pos end) as rk
    from forecasts) f where rk = 1),
latest as (
  select sector_label, {', '.join(f'arg_max({c}, case when {c} is not null then ts end) as {c}' for c in FEATS)}
  from test_rows group by sector_label),
scores as (
  select *, 0.0 + coalesce(filing_rate_3m_patent, 0) * 0.3 + coalesce(funding_deals_velocity_3m_funding, 0) * 0.25
             + coalesce(publication_rate_3m_research, 0) * 0.25 as emergence_score
  from latest)"""


def _row_mean(cols: list[str]) -> str:
    num = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    den = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in cols)
    return f"(case when ({den}) > 0 then (0.0 + {num}) / ({den}) end)"


def _fam(tag: str) -> list[str]:
    return [c for c in FEATS if tag in c]


def _risk_sql(src: str) -> str:
    def below(feat: str, tag: str) -> str:
        return f"coalesce({feat} < {_row_mean(_fam(tag))} * 0.25, false)"
    return f"""select *,
    list_filter([case when {below('funding_deals_velocity_3m_funding', '_funding')} then 'Funding/Commercialization Lag' end,
                 case when {below('publication_rate_3m_research', '_research')} then 'Weakening Research Base' end,
                 case when {below('filing_rate_3m_patent', '_patent')} then 'Slowing IP Generation' end], lambda x: x is not null) as risks0,
    case when emergence_score >= 0.7 then '0-1 year' when emergence_score >= 0.4 then '1-2 years' else '2-3+ years' end as timeline_estimate,
    case when emergence_score >= 0.7 then 'High' when emergence_score >= 0.4 then 'Medium' else 'Low' end as confidence_level
  from {src}"""


def _risk_final() -> str:
    return ("case when len(risks0) = 0 and confidence_level <> 'High' then ['Market Adoption Uncertainty'] "
            "when len(risks0) > 2 then risks0[1:2] else risks0 end")


def _fallback_ind() -> str:
    return ("case when emergence_score > 0 then concat('Overall positive momentum (Score: ', printf('%.2f', emergence_score), ')') "
            "else 'No specific strong positive indicators found.' end")


EMERGING_SQL_CTES = FC_CTES + f""",
thr as (
  select case when count_if(emergence_score > 0) = 0 or count_if(emergence_score > 0) < 2.0
              then coalesce(max(case when emergence_score > 0 then emergence_score end), 0)
              else quantile_cont(case when emergence_score > 0 then emergence_score end, 0.5) end as threshold
  from scores),
chosen as (select s.*, t.threshold, true as is_above_threshold from scores s cross join thr t
           where s.emergence_score >= t.threshold and s.emergence_score > 0),
risked as ({_risk_sql('chosen')}),
emerging as (
  select *, {_fallback_ind()} as key_indicators, array_to_string({_risk_final()}, '|') as risk_factors from risked)"""


def _q(name: str, body: str, **fin) -> str:
    return finish_sql(FC_CTES + "\n" + body, **fin)


# ---------------------------------------------------------------------------
# ML-5 validation metrics, FC-1..5
# ---------------------------------------------------------------------------
@register("validation_metrics", _q("validation_metrics", "select * from metrics",
                                   d6=("mae", "rmse", "direction_accuracy"), ints=("n_test",)))
def validation_metrics(spark, sf):
    return present(FC.validation_metrics(spark, sf))


@register("model_predictions", _q("model_predictions", "select * from cur_preds", d6=("prediction",)))
def model_predictions(spark, sf):
    return present(FC.current_predictions(spark, sf))


@register("ensemble_forecast", _q("ensemble_forecast", "select * from ens", d6=("prediction",), ints=("n_models",)))
def ensemble_forecast(spark, sf):
    return present(fc.ensemble(FC.current_predictions(spark, sf), K, FC.TREND_WEIGHTS))


@register("forecast_intervals", _q("forecast_intervals", "select * from ci",
                                   d6=("ci68_low", "ci68_high", "ci95_low", "ci95_high")))
def forecast_intervals(spark, sf):
    return present(fc.intervals(FC.current_predictions(spark, sf), K))


_FCOLS = dict(d6=("prediction", "ci68_low", "ci68_high", "ci95_low", "ci95_high", "quality_score"),
              ints=("horizon_pos", "horizon_months"), ts=("generated_at",))


@register("sector_forecasts", _q("sector_forecasts", "select * from forecasts", **_FCOLS))
def sector_forecasts(spark, sf):
    return present(FC.forecasts(spark, sf))


@register("summary_horizon", _q("summary_horizon", "select * from summary", **_FCOLS))
def summary_horizon(spark, sf):
    return present(FC.summary(spark, sf))


# ---------------------------------------------------------------------------
# AG-23 / ML-6 innovation indices
# ---------------------------------------------------------------------------
_IW = IndexWeights()


def _indices_sql() -> str:
    from trendspark.plans.queries_features import ORACLES_FOR_INDICES
    feats = list(_IW.patent) + list(_IW.funding) + list(_IW.research)
    norm = ", ".join(
        f"coalesce(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 0) as {c}" for c in feats)

    def wm(w: dict) -> str:
        tot = sum(w.values())
        return "(" + " + ".join(f"coalesce({c}, 0) * {v!r}" for c, v in w.items()) + f") / {tot!r}"
    return ORACLES_FOR_INDICES + f""",
normed as (select sector_label, {norm} from bundles),
scored as (select sector_label, {wm(_IW.patent)} as patent_score, {wm(_IW.funding)} as funding_score,
                  {wm(_IW.research)} as research_score from normed)
select sector_label, patent_score, funding_score, research_score,
       0.40 * patent_score + 0.35 * funding_score + 0.25 * research_score as innovation_index,
       0.60 * funding_score + 0.40 * patent_score as commercial_readiness_index,
       0.70 * research_score + 0.30 * patent_score as research_momentum_index
from scored"""


@register("innovation_indices", finish_sql(_indices_sql(), d6=(
    "patent_score", "funding_score", "research_score", "innovation_index", "commercial_readiness_index",
    "research_momentum_index")))
def innovation_indices(spark, sf):
    from trendspark.plans.queries_features import PAPER_PARAMS
    b = join_keys(join_keys(patent_features(B.patents(spark, sf), keys=K, as_of=B.AS_OF),
                            funding_features(B.funding(spark, sf), keys=K, as_of=B.AS_OF), K, "full"),
                  research_features(B.papers(spark, sf), keys=K, as_of=B.AS_OF, params=PAPER_PARAMS), K, "full")
    feats = list(_IW.patent) + list(_IW.funding) + list(_IW.research)
    # one row per sector: normalising across sectors is a tiny global step
    normed = ts.minmax(b.select(*K, *feats).withColumn("_all", F.lit(1)), ["_all"], feats)
    return present(fc.innovation_indices(normed, K, _IW.patent, _IW.funding, _IW.research))


# ---------------------------------------------------------------------------
# EM-1..5, TK-1, TK-3..5
# ---------------------------------------------------------------------------
@register("emergence_scores", finish_sql(FC_CTES + "\nselect sector_label, emergence_score from scores",
                                         d6=("emergence_score",)))
def emergence_scores(spark, sf):
    return present(FC.emergence_scores(spark, sf).select(*K, "emergence_score"))


_EM_OUT = ("sector_label", "emergence_score", "threshold", "is_above_threshold", "key_indicators",
           "timeline_estimate", "confidence_level", "risk_factors")


@register("emerging_technologies", finish_sql(EMERGING_SQL_CTES + f"\nselect {', '.join(_EM_OUT)} from emerging",
                                              d6=("emergence_score", "threshold")))
def emerging_technologies(spark, sf):
    out = FC.emerging_technologies(spark, sf, percentile=50.0)
    return present(out.select(*_EM_OUT).orderBy(F.col("emergence_score").desc()))


@register("top_emerging", finish_sql(EMERGING_SQL_CTES + """
select sector_label, emergence_score from emerging order by emergence_score desc, sector_label limit 3""",
    d6=("emergence_score",)))
def top_emerging(spark, sf):
    out = FC.emerging_technologies(spark, sf, percentile=50.0)
    return present(out.orderBy(F.col("emergence_score").desc(), "sector_label").limit(3)
                   .select("sector_label", "emergence_score"))


def _signals_sql() -> str:
    pretty = {n: n.replace("_", " ").title() for n in FC.FEATURE_INDICATORS}
    unp = " union all ".join(
        f"select sector_label, {i} as pos, {c} as v, {c} * {w!r} as contrib, '{pretty[c]}' as pretty from scores"
        for i, (c, w) in enumerate(FC.FEATURE_INDICATORS.items()))
    return FC_CTES + f""",
contribs as (
  select sector_label, string_agg(txt, '|' order by rk) as top
  from (select sector_label, concat(pretty, ' (Value: ', printf('%.2f', v), ', Contribution: ', printf('%.2f', contrib), ')') as txt,
               row_number() over (partition by sector_label order by contrib desc, pos) as rk
        from ({unp}) u where v > 0 and contrib > 0) r
  where rk <= 3 group by sector_label),
risked as ({_risk_sql('scores')})
select r.sector_label, r.emergence_score, coalesce(c.top, {_fallback_ind().replace('emergence_score', 'r.emergence_score')}) as key_indicators,
       r.timeline_estimate, r.confidence_level, array_to_string({_risk_final()}, '|') as risk_factors
from risked r left join contribs c on c.sector_label is not distinct from r.sector_label"""


@register("emergence_signals", finish_sql(_signals_sql(), d6=("emergence_score",)))
def emergence_signals(spark, sf):
    from trendspark.operators import emergence as em
    scored = FC.emergence_scores(spark, sf)
    out = em.signals(scored, EP, FC.FEATURE_INDICATORS)
    return present(out.select("sector_label", "emergence_score", "key_indicators", "timeline_estimate",
                              "confidence_level", "risk_factors"))


# ---------------------------------------------------------------------------
# IV-1..3
# ---------------------------------------------------------------------------
def _attr_sql(src: str, g: str, q: str, m: str, sector: str) -> str:
    pct = f"concat(printf('%.2f', {g} * 100.0), '%')"
    mil = f"printf('%.0f', {m} / 1e6)"
    return f"""select *,
    {g} * 0.4 + {q} * 0.3 + ({m} / 1e9) * 0.2 + 0.1 as attractiveness_score,
    array_to_string(list_filter([
      case when {g} >= 0.1 then concat('Strong Growth Potential (', {pct}, ')')
           when {g} > 0 then concat('Moderate Growth Potential (', {pct}, ')')
           else concat('Low/Negative Growth (', {pct}, ')') end,
      case when {q} >= 0.8 then 'High Prediction Confidence' end,
      case when {m} >= 500000000 then concat('Large Market Size ($', {mil}, 'M)')
           when {m} > 0 then concat('Market Size ($', {mil}, 'M)') end], lambda x: x is not null), '|') as key_drivers,
    array_to_string(coalesce(nullif(list_filter([
      case when {q} < 0.4 then 'Very Low Prediction Confidence' when {q} < 0.6 then 'Medium/Low Prediction Confidence' end,
      case when {m} < 100000000 and {m} > 0 then concat('Niche or Potentially Small Market ($', {mil}, 'M)')
           when {m} = 0 and {sector} <> 'Emerging Technology' then 'Market Size Unknown/Unverified' end,
      case when {g} < 0.01 then concat('Low or Negative Growth Forecast (', {pct}, ')') end], lambda x: x is not null), []),
      ['Standard market and execution risks apply.']), '|') as risk_assessment,
    case when {g} * 0.4 + {q} * 0.3 + ({m} / 1e9) * 0.2 + 0.1 > 0.5 and {g} > 0.05 and {q} >= 0.8 then 'Consider Investment'
         when {g} * 0.4 + {q} * 0.3 + ({m} / 1e9) * 0.2 + 0.1 > 0.3 and {g} > 0 then 'Monitor Closely'
         else 'Monitor' end as recommended_action
  from {src}"""


_INV_SRC = """(select s.sector_label as sector, s.horizon_key, coalesce(s.prediction, 0) as g, coalesce(s.quality_score, 0) as q,
        coalesce(mk.market_size_usd, 0) as m, mk.market_size_usd
 from summary s left join market mk on mk.sector_label is not distinct from s.sector_label
 where s.quality_score >= 0.4)"""


@register("investment_scores", finish_sql(with_views(["market"], FC_CTES + ",\ninv as (" + _attr_sql(
    _INV_SRC, "g", "q", "m", "sector") + ")\nselect sector, g as expected_growth, q as quality_score, market_size_usd, "
    "attractiveness_score, key_drivers, risk_assessment, recommended_action from inv"),
    d6=("expected_growth", "quality_score", "attractiveness_score"), d4=("market_size_usd",)))
def investment_scores(spark, sf):
    s = FC.summary(spark, sf).where(F.col("quality_score") >= IP.confidence_low).withColumnRenamed("sector_label", "sector")
    s = join_keys(s, B.market(spark, sf).withColumnRenamed("sector_label", "sector"), ["sector"], "left")
    out = iv.attractiveness(s.withColumn("expected_growth", F.col("prediction")), IP)
    return present(out.select("sector", "expected_growth", "quality_score", "market_size_usd", "attractiveness_score",
                              "key_drivers", "risk_assessment", "recommended_action"), d4=("market_size_usd",))


@register("investment_opportunities", finish_sql(with_views(["market"], EMERGING_SQL_CTES + ",\ninv as (" + _attr_sql(
    _INV_SRC, "g", "q", "m", "sector") + ")" + """
select 'Established Sector' as type, sector, split_part(horizon_key, '_', 1) as horizon_analyzed,
       g as expected_growth, CAST(NULL AS VARCHAR) as expected_growth_label, q as prediction_confidence_score,
       CAST(NULL AS VARCHAR) as prediction_confidence_label, attractiveness_score, key_drivers, risk_assessment,
       recommended_action from inv
union all
select 'Emerging Technology', sector_label, timeline_estimate, NULL, 'High Potential', NULL, confidence_level,
       emergence_score, key_indicators, risk_factors, 'Monitor for Early Investment' from emerging"""),
    d6=("expected_growth", "prediction_confidence_score", "attractiveness_score")))
def investment_opportunities(spark, sf):
    return present(FC.opportunities(spark, sf, IP))


# ---------------------------------------------------------------------------
# FLT-11 minimum samples, FLT-12 sectors without a model
# ---------------------------------------------------------------------------
@register("eligible_sectors", finish_sql(aligned_sql_ctes() + """
select sector_label, count(*) as n_rows from aligned group by 1 having count(*) >= 20""", ints=("n_rows",)))
def eligible_sectors(spark, sf):
    counts = P.aligned_panel(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"))
    return present(counts.where(F.col("n_rows") >= 20))


@register("sectors_without_model", finish_sql(FC_CTES + """
select distinct a.sector_label from aligned a
where not exists (select 1 from metrics m where m.sector_label is not distinct from a.sector_label
                    and m.model = 'linear_trend' and m.mae <= 0.15)"""))
def sectors_without_model(spark, sf):
    # registry of accepted models: linear-trend fits within the MAE acceptance limit
    registry = FC.validation_metrics(spark, sf).where((F.col("model") == "linear_trend") & (F.col("mae") <= MP.max_mae))
    sectors = P.aligned_panel(spark, sf).select(*K).distinct()
    return present(join_keys(sectors, registry.select(*K), K, "left_anti"))


# ---------------------------------------------------------------------------
# UN-1..5
# ---------------------------------------------------------------------------
def _completeness_sql() -> str:
    from trendspark.plans.queries_timeseries import PAT_COLS, FUND_COLS, RES_COLS
    fams = {"patents": PAT_COLS, "funding": FUND_COLS, "research": RES_COLS}
    parts = " union all ".join(
        f"select sector_label, '{s}' as source, (0.0 + {' + '.join(f'CAST({c} IS NOT NULL AS DOUBLE)' for c in cols)}) / {float(len(cols))} as v from merged"
        for s, cols in fams.items())
    return f""",
comp as (select sector_label, source, avg(v) as completeness from ({parts}) u group by 1, 2),
comp_adj as (
  select *, case when completeness < 0.4 then -0.2 when completeness < 0.8 then -0.1 else 0.0 end as confidence_adjustment,
    case when completeness < 0.4 then concat('Warning (', sector_label, '): ', source, ' data very incomplete (', printf('%.0f', completeness * 100.0), '%). Confidence reduced.')
         when completeness < 0.8 then concat('Caution (', sector_label, '): ', source, ' data incomplete (', printf('%.0f', completeness * 100.0), '%). Confidence reduced.')
         else '' end as message
  from comp)"""


@register("completeness_impact", finish_sql(aligned_sql_ctes() + _completeness_sql() + "\nselect * from comp_adj",
                                           d6=("completeness", "confidence_adjustment")))
def completeness_impact(spark, sf):
    return present(FC.completeness(spark, sf))


def _signals_cte() -> str:
    return """,
zsig as (
  select sector_label,
    (filing_rate_3m_patent - avg(filing_rate_3m_patent) over ()) / coalesce(nullif(stddev_pop(filing_rate_3m_patent) over (), 0), 1) as pat,
    (funding_deals_velocity_3m_funding - avg(funding_deals_velocity_3m_funding) over ()) / coalesce(nullif(stddev_pop(funding_deals_velocity_3m_funding) over (), 0), 1) as fund,
    (publication_rate_3m_research - avg(publication_rate_3m_research) over ()) / coalesce(nullif(stddev_pop(publication_rate_3m_research) over (), 0), 1) as res
  from latest),
sig as (
  select sector_label,
    list_sort(list_filter(['fund', 'pat', 'res'], lambda k: (case k when 'pat' then pat when 'fund' then fund else res end) > 0.5)) as pos,
    list_sort(list_filter(['fund', 'pat', 'res'], lambda k: (case k when 'pat' then pat when 'fund' then fund else res end) < -0.5)) as neg
  from zsig),
conflict as (
  select sector_label,
    case when len(pos) > 0 and len(neg) > 0 then -0.15 else 0.0 end as confidence_adjustment,
    case when len(pos) > 0 and len(neg) > 0 then 'conflicting' else 'consistent' end as status,
    case when len(pos) > 0 and len(neg) > 0
         then concat('Conflicting signals for ''', sector_label, '''. Pos: {', array_to_string(list_transform(pos, lambda k: concat('''', k, '''')), ', '),
                     '}, Neg: {', array_to_string(list_transform(neg, lambda k: concat('''', k, '''')), ', '),
                     '}. Increased uncertainty. Consider scenario analysis.')
         else concat('Signals for ''', sector_label, ''' generally consistent.') end as message,
    len(pos) > 0 and len(neg) > 0 as scenarios_suggested
  from sig)"""


@register("conflicting_signals", finish_sql(FC_CTES + _signals_cte() + "\nselect * from conflict",
                                           d6=("confidence_adjustment",)))
def conflicting_signals(spark, sf):
    return present(FC.conflicts(spark, sf).drop("signals"))


_COVERAGE_CTE = """,
coverage as (
  select sector_label, count_if(abstract is not null and length(abstract) >= 100) / count(*) as coverage
  from papers group by 1),
gap as (
  select *, case when coverage < 0.3 then -0.15 when coverage < 0.6 then -0.05 else 0.0 end as confidence_adjustment,
    case when coverage < 0.3 then concat('Warning (', sector_label, '): Research visibility gap - sparse papers (', printf('%.0f', coverage * 100.0), '%). Low research insight reliability.')
         when coverage < 0.6 then concat('Caution (', sector_label, '): Moderate research visibility gap (', printf('%.0f', coverage * 100.0), '%). Caution with research insights.')
         else '' end as message
  from coverage)"""


@register("research_gap", finish_sql(with_views(["papers"], "with " + _COVERAGE_CTE.lstrip(",\n") + "\nselect * from gap"),
                                     d6=("coverage", "confidence_adjustment")))
def research_gap(spark, sf):
    return present(FC.paper_coverage(spark, sf))


@register("final_predictions", finish_sql(FC_CTES + _completeness_sql() + _signals_cte() + _COVERAGE_CTE + """,
adj as (select sector_label, sum(confidence_adjustment) as adjustments from (
  select sector_label, confidence_adjustment from comp_adj union all
  select sector_label, confidence_adjustment from conflict union all
  select sector_label, confidence_adjustment from gap) u group by 1),
fin as (
  select s.sector_label, s.prediction as prediction_value,
    greatest(0.0, least(1.0, s.quality_score + coalesce(a.adjustments, 0))) as final_confidence_score, s.ci95_low, s.ci95_high, s.ci68_low, s.ci68_high
  from summary s left join adj a on a.sector_label is not distinct from s.sector_label)
select sector_label, prediction_value, final_confidence_score,
  case when final_confidence_score < 0.4 then 'Low' when final_confidence_score < 0.6 then 'Medium' else 'High' end as confidence_label,
  coalesce(case when ci95_low is not null and ci95_high is not null then concat('[', printf('%.3f', ci95_low), ', ', printf('%.3f', ci95_high), '] (95% CI)') end,
           case when ci68_low is not null and ci68_high is not null then concat('[', printf('%.3f', ci68_low), ', ', printf('%.3f', ci68_high), '] (68% CI)') end,
           'N/A') as confidence_interval_str,
  case when final_confidence_score < 0.4 then 'Low confidence. Interpret with extreme caution.'
       when final_confidence_score < 0.6 then 'Medium confidence. Corroborate with other sources.'
       else 'High confidence. Subject to unforeseen events.' end as disclaimer
from fin""", d6=("prediction_value", "final_confidence_score")))
def final_predictions(spark, sf):
    return present(FC.final_predictions(spark, sf))


@register("source_recommendations", finish_sql(aligned_sql_ctes() + _completeness_sql() + """
select source, sector_label, concat('Issue with ''', source, ''' for ''', sector_label, ''': ', message,
  '. Consider: [Expert Interviews], [Market Reports], [Analogous Sector Analysis], [Scenario Planning].') as recommendation
from comp_adj where confidence_adjustment < 0"""))
def source_recommendations(spark, sf):
    c = FC.completeness(spark, sf).where(F.col("confidence_adjustment") < 0)
    return present(c.select("source", "sector_label",
                            un.recommendation(F.col("source"), F.col("sector_label"), F.col("message")).alias("recommendation")))


# ---------------------------------------------------------------------------
# MO-1..6, JN-8/9
# ---------------------------------------------------------------------------
_LATEST_SQL = """latest_status as (
  select pipeline_name, last_run_timestamp, status, details from (
    select *, row_number() over (partition by pipeline_name order by last_run_timestamp desc, row_key desc) as rn
    from status_log) s where rn = 1)"""
_EXPECTED = ", ".join(f"('{k}', {v})" for k, v in MP.pipelines.items())
_LOOKUP_SQL = f"""lookup as (
  select e.pipeline_name, e.max_delay_days, l.last_run_timestamp,
         case when l.pipeline_name is null then 'NOT_FOUND' else l.status end as status,
         case when l.pipeline_name is null then 'Pipeline status not found in DB.' else l.details end as details
  from (values {_EXPECTED}) e(pipeline_name, max_delay_days) left join latest_status l on l.pipeline_name = e.pipeline_name)"""
_HEALTH_SQL = f"""health as (
  select pipeline_name, last_run_timestamp, status,
    last_run_timestamp is null or last_run_timestamp < {STATUS_AS_OF_SQL} - to_days(max_delay_days) as delayed,
    status <> 'SUCCESS' as failed
  from lookup),
health2 as (select *, not delayed and not failed as healthy from health),
health_all as (select h.*, b.all_healthy from health2 h cross join (select bool_and(healthy) as all_healthy from health2) b)"""


@register("latest_status", finish_sql(with_views(["status_log"], f"with {_LATEST_SQL}\nselect * from latest_status"),
                                      ts=("last_run_timestamp",)))
def latest_status(spark, sf):
    return present(mo.latest_status(B.status_log(spark, sf), tie="row_key"))


@register("status_lookup", finish_sql(with_views(["status_log"], f"with {_LATEST_SQL},\n{_LOOKUP_SQL}\n"
                                                 "select * from lookup where pipeline_name = 'funding_pipeline'"),
                                      ts=("last_run_timestamp",), ints=("max_delay_days",)))
def status_lookup(spark, sf):
    latest = mo.latest_status(B.status_log(spark, sf), tie="row_key")
    look = mo.status_lookup(latest, mo.expected_pipelines(spark, MP))
    return present(look.where(F.col("pipeline_name") == "funding_pipeline"))


@register("pipeline_health", finish_sql(with_views(["status_log"], f"with {_LATEST_SQL},\n{_LOOKUP_SQL},\n{_HEALTH_SQL}\n"
                                                   "select * from health_all"), ts=("last_run_timestamp",)))
def pipeline_health(spark, sf):
    return present(FC.pipeline_health(spark, sf))


_WATCH = [f for f in MP.drift_thresholds]
_DRIFT_CTES = f""",
baseline as (
  {' union all '.join(f"select '{f}' as feature, avg({f}) as mean, stddev_samp({f}) as std from split where split = 'train'" for f in _WATCH)}),
cur as (
  {' union all '.join(f"select sector_label, '{f}' as feature, avg({f}) as current_mean from test_rows group by 1" for f in _WATCH)}),
thresholds as (select * from (values {', '.join(f"('{k}', {v!r}::DOUBLE)" for k, v in MP.drift_thresholds.items())}) t(feature, threshold)),
drift0 as (
  select c.sector_label, c.feature, c.current_mean, b.mean as baseline_mean,
    case when b.mean <> 0 then abs(c.current_mean - b.mean) / abs(b.mean)
         when c.current_mean <> 0 then 'Infinity'::DOUBLE else 0.0 end as change,
    coalesce(t.threshold, 0.2) as thr
  from cur c join baseline b on b.feature = c.feature left join thresholds t on t.feature = c.feature
  where c.current_mean is not null and b.mean is not null and not isnan(c.current_mean) and not isnan(b.mean)),
drift as (
  select sector_label, feature, current_mean, baseline_mean, change,
         case when change > thr then 'DRIFT' else 'STABLE' end as status,
         bool_or(change > thr) over (partition by sector_label) as drift_detected
  from drift0)"""


# money-sized features share these columns: compared at 4 places (14 significant
# digits is beyond what two variance algorithms agree on)
@register("drift_baseline", finish_sql(FC_CTES + _DRIFT_CTES + "\nselect * from baseline", d4=("mean", "std")))
def drift_baseline(spark, sf):
    return present(FC.drift_baseline(spark, sf), d4=("mean", "std"))


@register("drift_check", finish_sql(FC_CTES + _DRIFT_CTES + "\nselect * from drift",
                                    d4=("current_mean", "baseline_mean"), d6=("change",)))
def drift_check(spark, sf):
    return present(FC.drift_check(spark, sf), d4=("current_mean", "baseline_mean"))


_PERF_CTE = """,
perf as (
  select sector_label,
    bool_or(mae > 0.15 or direction_accuracy < 0.65 or mae is null or direction_accuracy is null) as degraded,
    count(*) as n_models, max(mae) as worst_mae, min(direction_accuracy) as worst_direction_accuracy
  from metrics group by 1)"""


@register("performance_gate", finish_sql(FC_CTES + _PERF_CTE + "\nselect * from perf",
                                         d6=("worst_mae", "worst_direction_accuracy"), ints=("n_models",)))
def performance_gate(spark, sf):
    return present(FC.performance_gate(spark, sf))


@register("maintenance_report", finish_sql(with_views(["status_log"], FC_CTES + _DRIFT_CTES + _PERF_CTE + f""",
{_LATEST_SQL},
{_LOOKUP_SQL},
{_HEALTH_SQL},
hh as (select bool_and(healthy) as healthy from health2),
dd as (select sector_label, bool_or(status = 'DRIFT') as drifted from drift group by 1),
sectors as (select coalesce(d.sector_label, p.sector_label) as sector_label, d.drifted, p.degraded
            from dd d full outer join perf p on p.sector_label is not distinct from d.sector_label)
select s.sector_label, h.healthy,
  case when h.healthy then s.drifted end as drifted,
  case when h.healthy then s.degraded end as degraded,
  h.healthy and coalesce(s.degraded, false) and {str(MP.auto_retraining_enabled).lower()} as retrain,
  case when h.healthy then 'COMPLETED' else 'ABORTED' end as maintenance_status
from sectors s cross join hh h""")))
def maintenance_report(spark, sf):
    return present(FC.maintenance_report(spark, sf))


# ---------------------------------------------------------------------------
# SRC-2 load-or-rebuild, SNK-1..3 status log round trip
# ---------------------------------------------------------------------------
@register("status_log_roundtrip", finish_sql(with_views(["status_log"], f"with {_LATEST_SQL}\nselect * from latest_status"),
                                             ts=("last_run_timestamp",)))
def status_log_roundtrip(spark, sf):
    """Status rows appended (in bulk) to a fresh status log, read back as the
    latest row per pipeline."""
    import uuid
    from trendspark.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trendspark-status/{uuid.uuid4().hex}"
    mo.ensure_status_log(spark, path)
    B.status_log(spark, sf).write.mode("append").parquet(path)
    return present(mo.latest_status(mo.read_status_log(spark, path), tie="row_key"))
