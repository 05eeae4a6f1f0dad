"""Registered feature queries (AG-*) on the fixture bindings."""
from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.functions.text import keyword_count
from trendspark.operators import features as feat
from trendspark.params import FeatureParams
from trendspark.plans.registry import AS_OF_SQL as ASOF, ORACLES, finish_sql, present, register, with_views

# FIXED VALUES: keywords frequent in the English rows of the documents table.
PAPER_KEYWORDS = ("thatin", "ononst", "inoran", "hehely", "orantion")
PAPER_PARAMS = FeatureParams(keywords=PAPER_KEYWORDS)
K = ["sector_label"]


# ----------------------------------------------------------------- SRC-1
@register("scan_orders", finish_sql("""
select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority from orders
""", d6=("o_totalprice",), ts=("o_orderdate",)))
def scan_orders(spark, sf):
    o = B.table(spark, sf, "orders")
    return present(o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"))


# ----------------------------------------------------------------- AG-1
@register("event_rates", finish_sql(with_views(["patents"], f"""
select sector_label,
  count_if(filing_date >= {ASOF} - INTERVAL 1 MONTH) / 1::DOUBLE as rate_1m,
  count_if(filing_date >= {ASOF} - INTERVAL 3 MONTH) / 3::DOUBLE as rate_3m,
  count_if(filing_date >= {ASOF} - INTERVAL 6 MONTH) / 6::DOUBLE as rate_6m,
  count_if(filing_date >= {ASOF} - INTERVAL 12 MONTH) / 12::DOUBLE as rate_12m
from patents group by sector_label"""), d6=("rate_1m", "rate_3m", "rate_6m", "rate_12m")))
def event_rates(spark, sf):
    p = B.patents(spark, sf)
    return present(p.groupBy(*K).agg(*[feat.event_rate("filing_date", B.AS_OF, m).alias(f"rate_{m}m")
                                       for m in (1, 3, 6, 12)]))


# ----------------------------------------------------------------- AG-2
@register("sum_rates", finish_sql(with_views(["funding"], f"""
select sector_label,
  coalesce(sum(case when date >= {ASOF} - INTERVAL 1 MONTH then amount_usd end), 0) / 1::DOUBLE as amount_rate_1m,
  coalesce(sum(case when date >= {ASOF} - INTERVAL 3 MONTH then amount_usd end), 0) / 3::DOUBLE as amount_rate_3m,
  coalesce(sum(case when date >= {ASOF} - INTERVAL 6 MONTH then amount_usd end), 0) / 6::DOUBLE as amount_rate_6m
from funding group by sector_label"""), d4=("amount_rate_1m", "amount_rate_3m", "amount_rate_6m")))
def sum_rates(spark, sf):
    f = B.funding(spark, sf)
    return present(f.groupBy(*K).agg(*[feat.sum_rate("date", "amount_usd", B.AS_OF, m).alias(f"amount_rate_{m}m")
                                       for m in (1, 3, 6)]),
                   d4=("amount_rate_1m", "amount_rate_3m", "amount_rate_6m"))


# ----------------------------------------------------------------- AG-3
@register("tech_diversity", finish_sql(with_views(["patents"], """
select sector_label, -sum(p * log2(p + 1e-10)) as tech_diversity_shannon
from (select sector_label, c / sum(c) over (partition by sector_label) as p
      from (select sector_label, tech_class, count(*) c from patents
            where tech_class is not null group by 1, 2) t) s
group by sector_label"""), d6=("tech_diversity_shannon",)))
def tech_diversity(spark, sf):
    return present(feat.shannon_diversity(B.patents(spark, sf), K, "tech_class", name="tech_diversity_shannon"))


# ----------------------------------------------------------------- AG-4
@register("category_diversity", finish_sql(with_views(["papers"], """
select sector_label, -sum(p * log2(p + 1e-10)) as category_diversity_shannon
from (select sector_label, c / sum(c) over (partition by sector_label) as p
      from (select sector_label, cat, count(*) c
            from (select sector_label, unnest(categories) as cat from papers) u
            where cat is not null group by 1, 2) t) s
group by sector_label"""), d6=("category_diversity_shannon",)))
def category_diversity(spark, sf):
    return present(feat.shannon_diversity(B.papers(spark, sf), K, "categories", explode=True,
                                          name="category_diversity_shannon"))


# ----------------------------------------------------------------- AG-5
@register("unique_inventors", finish_sql(with_views(["patents"], """
select sector_label, count(distinct inv) as unique_inventor_count
from (select sector_label, unnest(inventors) as inv from patents) u
where inv is not null group by sector_label"""), ints=("unique_inventor_count",)))
def unique_inventors(spark, sf):
    return present(feat.distinct_exploded(B.patents(spark, sf), K, "inventors", "unique_inventor_count"))


# ----------------------------------------------------------------- AG-6
_VEL_SQL = f"""citations / (case when floor(date_diff('second', filing_date, {ASOF}) / 86400) / 30.44::DOUBLE = 0
                 then 1.0::DOUBLE else floor(date_diff('second', filing_date, {ASOF}) / 86400) / 30.44::DOUBLE end)"""


@register("citation_velocity", finish_sql(with_views(["patents"], f"""
select sector_label, coalesce(avg({_VEL_SQL}), 0) as citation_velocity_avg,
       count_if(filing_date > {ASOF}) as future_filings
from patents group by sector_label"""), d6=("citation_velocity_avg",), ints=("future_filings",)))
def citation_velocity(spark, sf):
    p = B.patents(spark, sf)
    return present(p.groupBy(*K).agg(
        F.coalesce(F.avg(feat.citation_rate("filing_date", "citations", B.AS_OF, 30.44)), F.lit(0.0))
        .alias("citation_velocity_avg"),
        F.count_if(F.col("filing_date") > B.ts_lit(B.AS_OF)).alias("future_filings")))


# ----------------------------------------------------------------- AG-8
@register("international_ratio", finish_sql(with_views(["patents"], """
select sector_label,
  case when min(source) <> max(source)
       then avg(case when coalesce(upper(source) in ('USPTO', 'US'), false) then 0.0 else 1.0 end)
       else 0.0 end as international_filing_ratio
from patents group by sector_label"""), d6=("international_filing_ratio",)))
def international_ratio(spark, sf):
    p = B.patents(spark, sf)
    return present(p.groupBy(*K).agg(feat.international_ratio("source").alias("international_filing_ratio")))


# ----------------------------------------------------------------- AG-10
@register("funding_gini", finish_sql(with_views(["funding"], """
select sector_label,
  case when max(n) >= 2 and sum(x) <> 0 then sum((2 * i - n - 1) * x) / (max(n) * sum(x)) else 0 end as funding_amount_gini
from (select sector_label, amount_usd as x,
             row_number() over (partition by sector_label order by amount_usd) as i,
             count(*) over (partition by sector_label) as n
      from funding where amount_usd is not null and amount_usd >= 0) r
group by sector_label"""), d6=("funding_amount_gini",)))
def funding_gini(spark, sf):
    from trendspark.operators.ranked import gini, value_ranks
    f = B.funding(spark, sf)
    return present(gini(value_ranks(f, K, "amount_usd"), K, "funding_amount_gini"))


# ----------------------------------------------------------------- AG-9 (exact median)
@register("funding_median", finish_sql(with_views(["funding"], """
select sector_label, median(amount_usd) as median_round_size_usd, avg(amount_usd) as avg_round_size_usd
from funding group by sector_label"""), d6=("median_round_size_usd", "avg_round_size_usd")))
def funding_median(spark, sf):
    from trendspark.operators.ranked import exact_median, value_ranks
    from trendspark.operators.common import join_keys
    f = B.funding(spark, sf)
    med = exact_median(value_ranks(f, K, "amount_usd"), K, "median_round_size_usd")
    avg = f.groupBy(*K).agg(F.avg("amount_usd").alias("avg_round_size_usd"))
    return present(join_keys(med, avg, K, "inner"))


# ----------------------------------------------------------------- AG-11
@register("stage_distribution", finish_sql(with_views(["funding"], """
select sector_label, stage, c / sum(c) over (partition by sector_label) as share
from (select sector_label, stage, count(*) c from funding where stage is not null group by 1, 2) t"""),
    d6=("share",)))
def stage_distribution(spark, sf):
    return present(feat.distribution(B.funding(spark, sf), K, "stage"))


# ----------------------------------------------------------------- AG-12
_STAGES_SQL = """
  case when count(stage) = 0 then 0.0
       when count_if(stage = 'seed') > 0 then count_if(stage = 'seed') / count(stage)
       else count_if(stage = 'Seed') / count(stage) end as seed_ratio,
  case when count(stage) = 0 then 0.0
       when count_if(stage = 'series_a') > 0 then count_if(stage = 'series_a') / count(stage)
       else count_if(stage = 'Series A') / count(stage) end as series_a_ratio,
  case when count(stage) = 0 then 0.0
       else count_if(stage in ('series_c', 'series_d', 'series_e', 'late_stage_venture',
                               'Series C', 'Series D', 'Series E')) / count(stage) end as late_stage_ratio"""


@register("stage_ratios", finish_sql(with_views(["funding"], f"""
select sector_label, {_STAGES_SQL}
from funding group by sector_label"""), d6=("seed_ratio", "series_a_ratio", "late_stage_ratio")))
def stage_ratios(spark, sf):
    return present(B.funding(spark, sf).groupBy(*K).agg(*feat.stage_ratios("stage")))


# ----------------------------------------------------------------- AG-14
@register("abstract_length", finish_sql(with_views(["papers"], """
select sector_label, avg(length(coalesce(abstract, ''))) as avg_abstract_length,
       max(length(coalesce(abstract, ''))) as max_abstract_length
from papers group by sector_label"""), d6=("avg_abstract_length",), ints=("max_abstract_length",)))
def abstract_length(spark, sf):
    p = B.papers(spark, sf)
    ln = F.length(F.coalesce(F.col("abstract"), F.lit("")))
    return present(p.groupBy(*K).agg(F.avg(ln).alias("avg_abstract_length"),
                                     F.max(ln).alias("max_abstract_length")))


# ----------------------------------------------------------------- AG-15
_KW_LIST_SQL = ", ".join(f"'{k}'" for k in PAPER_KEYWORDS)
_KW_SQL = (r"coalesce(len(list_filter(string_split_regex(lower(abstract), '\s+'), "
           r"lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') in (" + _KW_LIST_SQL + "))), 0)")


@register("keyword_counts", finish_sql(with_views(["papers"], f"""
select sector_label, sum({_KW_SQL}) as sum_keyword_count, avg({_KW_SQL}) as avg_keyword_count,
       count_if({_KW_SQL} > 0) as docs_with_keyword
from papers group by sector_label"""), d6=("avg_keyword_count",), ints=("sum_keyword_count", "docs_with_keyword")))
def keyword_counts(spark, sf):
    p = B.papers(spark, sf).withColumn("_kw", keyword_count("abstract", PAPER_KEYWORDS, PAPER_PARAMS.stop_words))
    return present(p.groupBy(*K).agg(F.sum("_kw").alias("sum_keyword_count"),
                                     F.avg("_kw").alias("avg_keyword_count"),
                                     F.count_if(F.col("_kw") > 0).alias("docs_with_keyword")))


# ----------------------------------------------------------------- AG-16
_PATENT_FEATURES_BODY = f"""
with main as (
  select sector_label,
    count_if(filing_date >= {ASOF} - INTERVAL 3 MONTH) / 3::DOUBLE as filing_rate_3m,
    count_if(filing_date >= {ASOF} - INTERVAL 6 MONTH) / 6::DOUBLE as filing_rate_6m,
    count_if(filing_date >= {ASOF} - INTERVAL 12 MONTH) / 12::DOUBLE as filing_rate_12m,
    coalesce(avg({_VEL_SQL}), 0) as citation_velocity_avg,
    avg(forward_citations) as forward_citation_rate_avg,
    case when min(source) <> max(source)
         then avg(case when coalesce(upper(source) in ('USPTO', 'US'), false) then 0.0 else 1.0 end)
         else 0.0 end as international_filing_ratio
  from patents group by sector_label),
div as (
  select sector_label, -sum(p * log2(p + 1e-10)) as tech_diversity_shannon
  from (select sector_label, c / sum(c) over (partition by sector_label) as p
        from (select sector_label, tech_class, count(*) c from patents
              where tech_class is not null group by 1, 2) t) s
  group by sector_label),
inv as (
  select sector_label, count(distinct i) as unique_inventor_count
  from (select sector_label, unnest(inventors) as i from patents) u where i is not null group by 1)
select main.sector_label, filing_rate_3m, filing_rate_6m, filing_rate_12m,
       coalesce(tech_diversity_shannon, 0) as tech_diversity_shannon,
       coalesce(unique_inventor_count, 0) as unique_inventor_count,
       citation_velocity_avg, forward_citation_rate_avg, international_filing_ratio
from main left join div on main.sector_label is not distinct from div.sector_label
          left join inv on main.sector_label is not distinct from inv.sector_label"""


@register("patent_features", finish_sql(with_views(["patents"], _PATENT_FEATURES_BODY),
    d6=("filing_rate_3m", "filing_rate_6m", "filing_rate_12m", "tech_diversity_shannon",
        "citation_velocity_avg", "forward_citation_rate_avg", "international_filing_ratio"),
    ints=("unique_inventor_count",)))
def patent_features(spark, sf):
    return present(feat.patent_features(B.patents(spark, sf), keys=K, as_of=B.AS_OF))


# ----------------------------------------------------------------- AG-17
_FUNDING_FEATURES_BODY = f"""
with main as (
  select sector_label,
    count_if(date >= {ASOF} - INTERVAL 3 MONTH) / 3::DOUBLE as funding_deals_velocity_3m,
    count_if(date >= {ASOF} - INTERVAL 6 MONTH) / 6::DOUBLE as funding_deals_velocity_6m,
    coalesce(sum(case when date >= {ASOF} - INTERVAL 3 MONTH then amount_usd end), 0) / 3::DOUBLE as funding_amount_velocity_3m_usd,
    coalesce(sum(case when date >= {ASOF} - INTERVAL 6 MONTH then amount_usd end), 0) / 6::DOUBLE as funding_amount_velocity_6m_usd,
    avg(amount_usd) as avg_round_size_usd,
    median(amount_usd) as median_round_size_usd,
    {_STAGES_SQL}
  from funding group by sector_label),
g as (
  select sector_label,
    case when max(n) >= 2 and sum(x) <> 0 then sum((2 * i - n - 1) * x) / (max(n) * sum(x)) else 0 end as funding_amount_gini
  from (select sector_label, amount_usd as x,
               row_number() over (partition by sector_label order by amount_usd) as i,
               count(*) over (partition by sector_label) as n
        from funding where amount_usd is not null and amount_usd >= 0) r
  group by sector_label)
select main.sector_label, funding_deals_velocity_3m, funding_deals_velocity_6m,
       funding_amount_velocity_3m_usd, funding_amount_velocity_6m_usd,
       avg_round_size_usd, median_round_size_usd, coalesce(funding_amount_gini, 0) as funding_amount_gini,
       seed_ratio, series_a_ratio, late_stage_ratio
from main left join g on main.sector_label is not distinct from g.sector_label"""


@register("funding_features", finish_sql(with_views(["funding"], _FUNDING_FEATURES_BODY),
    d6=("funding_deals_velocity_3m", "funding_deals_velocity_6m", "avg_round_size_usd", "median_round_size_usd",
        "funding_amount_gini", "seed_ratio", "series_a_ratio", "late_stage_ratio"),
    d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd")))
def funding_features(spark, sf):
    return present(feat.funding_features(B.funding(spark, sf), keys=K, as_of=B.AS_OF),
                   d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd"))


# ----------------------------------------------------------------- AG-18
_RESEARCH_FEATURES_BODY = f"""
with main as (
  select sector_label,
    count_if(published_date >= {ASOF} - INTERVAL 3 MONTH) / 3::DOUBLE as publication_rate_3m,
    count_if(published_date >= {ASOF} - INTERVAL 6 MONTH) / 6::DOUBLE as publication_rate_6m,
    avg(citation_count) as avg_citation_count,
    avg(len(authors)) as avg_authors_per_paper,
    avg(length(coalesce(abstract, ''))) as avg_abstract_length,
    avg({_KW_SQL}) as avg_keyword_count,
    sum({_KW_SQL}) as sum_keyword_count
  from papers group by sector_label),
div as (
  select sector_label, -sum(p * log2(p + 1e-10)) as category_diversity_shannon
  from (select sector_label, c / sum(c) over (partition by sector_label) as p
        from (select sector_label, cat, count(*) c
              from (select sector_label, unnest(categories) as cat from papers) u
              where cat is not null group by 1, 2) t) s
  group by sector_label)
select main.sector_label, publication_rate_3m, publication_rate_6m, avg_citation_count, avg_authors_per_paper,
       coalesce(category_diversity_shannon, 0) as category_diversity_shannon,
       avg_abstract_length, avg_keyword_count, sum_keyword_count
from main left join div on main.sector_label is not distinct from div.sector_label"""


@register("research_features", finish_sql(with_views(["papers"], _RESEARCH_FEATURES_BODY),
    d6=("publication_rate_3m", "publication_rate_6m", "avg_citation_count", "avg_authors_per_paper",
        "category_diversity_shannon", "avg_abstract_length", "avg_keyword_count"),
    ints=("sum_keyword_count",)))
def research_features(spark, sf):
    return present(feat.research_features(B.papers(spark, sf), keys=K, as_of=B.AS_OF, params=PAPER_PARAMS))


# ----------------------------------------------------------------- AG-19
@register("sector_counts", finish_sql(with_views(["patents"], """
select sector_label, count(*) as n_rows from patents group by sector_label"""), ints=("n_rows",)))
def sector_counts(spark, sf):
    return present(B.patents(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows")))


def _as_ctes(body: str, prefix: str) -> str:
    """Turn ``with a as (..), b as (..) select ..`` into prefixed CTEs ending
    in a CTE named ``prefix``."""
    import re
    body = body.strip()
    names = re.findall(r"(?:^with|,)\s*(\w+) as \(", body)
    for n in names:
        body = re.sub(rf"\b{n}\b", f"{prefix}_{n}", body)
    head, _, tail = body.rpartition("\nselect ")
    return head[len("with "):] + f",\n{prefix} as (select {tail})"


# Oracle CTEs with the three bundles per sector (used by the index oracle).
ORACLES_FOR_INDICES = with_views(["patents", "funding", "papers"], f"""with
{_as_ctes(_PATENT_FEATURES_BODY, "pb")},
{_as_ctes(_FUNDING_FEATURES_BODY, "fb")},
{_as_ctes(_RESEARCH_FEATURES_BODY, "rb")},
bundles as (
  select coalesce(pb.sector_label, fb.sector_label, rb.sector_label) as sector_label,
         pb.* exclude (sector_label), fb.* exclude (sector_label), rb.* exclude (sector_label)
  from pb full outer join fb on pb.sector_label is not distinct from fb.sector_label
  full outer join rb on coalesce(pb.sector_label, fb.sector_label) is not distinct from rb.sector_label)""")


# ----------------------------------------------------------------- SRC-2 / SNK-1
@register("cached_funding_features", ORACLES["funding_features"])
def cached_funding_features(spark, sf):
    """Built and written on the first call, read back on the second."""
    import uuid
    from trendspark.session import ensure_checkpoint_dir
    from trendspark.sources.scan import load_or_build
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trendspark-cache/funding-features-{uuid.uuid4().hex}"

    def build():
        return feat.funding_features(B.funding(spark, sf), keys=K, as_of=B.AS_OF)
    load_or_build(spark, path, build)
    cached = load_or_build(spark, path, build)  # present now: loaded, not rebuilt
    return present(cached, d4=("funding_amount_velocity_3m_usd", "funding_amount_velocity_6m_usd"))
