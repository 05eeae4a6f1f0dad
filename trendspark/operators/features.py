"""Trend features per group (AG-1 .. AG-18).

Each bundle is one conditional ``groupBy(keys).agg`` (all rate windows in a
single pass, partial aggregation before the shuffle) plus the few metrics
that need a second level (category counts, distinct inventors, ordered
values), joined on the group keys. ``keys=[]`` gives the one-row form.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions.scalars import finite
from trendspark.functions.text import keyword_count
from trendspark.operators.common import join_keys, months_before, ts_lit
from trendspark.operators.ranked import exact_median, gini, value_ranks
from trendspark.params import (DOMESTIC_SOURCES, LATE_STAGES, SEED_STAGES, SERIES_A_STAGES,
                               FeatureParams)

# --------------------------------------------------------------------------
# Aggregate expressions
# --------------------------------------------------------------------------


def event_rate(date_col: str, as_of: dt.datetime, months: int) -> Column:
    """AG-1: rows dated on/after ``as_of − months`` per month (no upper bound)."""
    return F.count_if(F.col(date_col) >= months_before(as_of, months)) / F.lit(float(max(months, 1)))


def sum_rate(date_col: str, value_col: str, as_of: dt.datetime, months: int) -> Column:
    """AG-2: sum of ``value_col`` over the same window per month; empty → 0."""
    s = F.sum(F.when(F.col(date_col) >= months_before(as_of, months), F.col(value_col)))
    return F.coalesce(s, F.lit(0.0)) / F.lit(float(max(months, 1)))


def citation_rate(date_col: str, cites_col: str, as_of: dt.datetime, days_per_month: float) -> Column:
    """AG-6 per row: citations / months since filing, whole days / 30.44, 0 → 1."""
    days = F.floor(F.timestamp_diff("SECOND", F.col(date_col), ts_lit(as_of)) / F.lit(86400))
    months = days / F.lit(days_per_month)
    rate = F.col(cites_col).cast("double") / F.when(months == 0, F.lit(1.0)).otherwise(months)
    return F.when(finite(rate), rate)


def international_ratio(source_col: str, domestic: tuple[str, ...] = DOMESTIC_SOURCES) -> Column:
    """AG-8: share of rows whose upper-cased source is not domestic (null counts
    as international); 0 unless there are at least 2 distinct sources."""
    dom = F.coalesce(F.upper(F.col(source_col)).isin(*domestic), F.lit(False))
    share = F.avg(F.when(dom, F.lit(0.0)).otherwise(F.lit(1.0)))
    return F.when(F.min(source_col) != F.max(source_col), share).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------
# Two-level metrics
# --------------------------------------------------------------------------


def shannon_diversity(df: DataFrame, keys: list[str], category: str, explode: bool = False,
                      name: str = "shannon", eps: float = 1e-10) -> DataFrame:
    """AG-3/AG-4: −Σ p·log2(p + eps) over category shares (nulls excluded).
    Groups without any category are absent (callers fill 0)."""
    cat = F.explode(F.col(category)) if explode else F.col(category)
    cats = df.select(*keys, cat.alias("_cat")).where(F.col("_cat").isNotNull())
    counts = cats.groupBy(*keys, "_cat").agg(F.count(F.lit(1)).alias("_c"))
    # totals per group (one row per group) joined back, not a window over all
    # of a hot group's categories in one task
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    shares = join_keys(counts, totals, keys, "inner").select(*keys, (F.col("_c") / F.col("_t")).alias("_p"))
    return shares.groupBy(*keys).agg(
        (-F.sum(F.col("_p") * F.log2(F.col("_p") + F.lit(eps)))).alias(name))


def distinct_exploded(df: DataFrame, keys: list[str], list_col: str, name: str, approx: bool = False) -> DataFrame:
    """AG-5: distinct non-null list elements per group (two-stage distinct);
    ``approx`` uses a HyperLogLog sketch (``approx_count_distinct``) instead."""
    items = df.select(*keys, F.explode(F.col(list_col)).alias("_it")).where(F.col("_it").isNotNull())
    if approx:
        return items.groupBy(*keys).agg(F.approx_count_distinct("_it").alias(name))
    return (items.groupBy(*keys, "_it").agg(F.lit(1).alias("_one"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))


def distribution(df: DataFrame, keys: list[str], category: str, name: str = "share") -> DataFrame:
    """AG-11: normalised value counts (nulls out of the denominator)."""
    counts = (df.where(F.col(category).isNotNull())
              .groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_c")))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    return join_keys(counts, totals, keys, "inner").select(*keys, category, (F.col("_c") / F.col("_t")).alias(name))


def _fill0(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols) if cols else df


# --------------------------------------------------------------------------
# Bundles
# --------------------------------------------------------------------------


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that a record set may lack, as typed nulls where it does: the
    metrics of a missing column are 0."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def patent_features(df: DataFrame, *, keys: list[str], as_of: dt.datetime,
                    params: FeatureParams = FeatureParams()) -> DataFrame:
    """AG-16: filing_rate_{3,6,12}m, tech_diversity_shannon,
    unique_inventor_count, citation_velocity_avg, forward_citation_rate_avg,
    international_filing_ratio. Empty input → no rows; missing columns → 0."""
    df = with_optional(df, {"filing_date": "timestamp_ntz", "citations": "int", "forward_citations": "int", "inventors": "array<string>",
                            "tech_class": "string", "source": "string"})
    rates = [event_rate("filing_date", as_of, m).alias(f"filing_rate_{m}m") for m in params.patent_rate_months]
    vel = F.coalesce(F.avg(citation_rate("filing_date", "citations", as_of, params.days_per_month)), F.lit(0.0))
    main = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *rates,
        vel.alias("citation_velocity_avg"),
        F.coalesce(F.avg("forward_citations"), F.lit(0.0)).alias("forward_citation_rate_avg"),
        international_ratio("source").alias("international_filing_ratio"))
    main = main.where(F.col("_n") > 0).drop("_n")
    div = shannon_diversity(df, keys, "tech_class", name="tech_diversity_shannon", eps=params.shannon_epsilon)
    inv = distinct_exploded(df, keys, "inventors", "unique_inventor_count", approx=not params.exact_quantiles)
    out = join_keys(join_keys(main, div, keys), inv, keys)
    out = _fill0(out, ["tech_diversity_shannon", "unique_inventor_count"])
    cols = [f"filing_rate_{m}m" for m in params.patent_rate_months] + [
        "tech_diversity_shannon", "unique_inventor_count", "citation_velocity_avg",
        "forward_citation_rate_avg", "international_filing_ratio"]
    return out.select(*keys, *cols)


def stage_ratios(stage_col: str = "stage") -> list[Column]:
    """AG-12 as aggregate expressions: seed / series A share (lower-case key
    first, title-case only when the first is absent) and the late-stage sum."""
    n = F.count(stage_col)

    def share(label: str) -> Column:
        return F.count_if(F.col(stage_col) == label) / n

    def first_present(a: str, b: str) -> Column:
        return F.when(F.count_if(F.col(stage_col) == a) > 0, share(a)).otherwise(share(b))

    late = F.count_if(F.col(stage_col).isin(*LATE_STAGES)) / n
    guard = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return [guard(first_present(*SEED_STAGES)).alias("seed_ratio"),
            guard(first_present(*SERIES_A_STAGES)).alias("series_a_ratio"),
            guard(late).alias("late_stage_ratio")]


def funding_features(df: DataFrame, *, keys: list[str], as_of: dt.datetime,
                     params: FeatureParams = FeatureParams()) -> DataFrame:
    """AG-17: funding_deals_velocity_{3,6}m, funding_amount_velocity_{3,6}m_usd,
    avg/median_round_size_usd, funding_amount_gini, seed/series_a/late_stage ratios."""
    df = with_optional(df, {"date": "timestamp_ntz", "amount_usd": "double", "stage": "string"})
    months = params.funding_rate_months
    aggs = ([event_rate("date", as_of, m).alias(f"funding_deals_velocity_{m}m") for m in months]
            + [sum_rate("date", "amount_usd", as_of, m).alias(f"funding_amount_velocity_{m}m_usd") for m in months]
            + [F.avg("amount_usd").alias("avg_round_size_usd")]
            + stage_ratios("stage"))
    if not params.exact_quantiles:
        aggs.append(F.percentile_approx("amount_usd", 0.5).cast("double").alias("median_round_size_usd"))
    main = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs).where(F.col("_n") > 0).drop("_n")
    ranks = value_ranks(df, keys, "amount_usd")
    out = main
    if params.exact_quantiles:
        out = join_keys(out, exact_median(ranks, keys, "median_round_size_usd"), keys)
    out = join_keys(out, gini(ranks, keys, "funding_amount_gini"), keys)
    out = _fill0(out, ["funding_amount_gini"])
    cols = ([f"funding_deals_velocity_{m}m" for m in months]
            + [f"funding_amount_velocity_{m}m_usd" for m in months]
            + ["avg_round_size_usd", "median_round_size_usd", "funding_amount_gini",
               "seed_ratio", "series_a_ratio", "late_stage_ratio"])
    return out.select(*keys, *cols)


def research_features(df: DataFrame, *, keys: list[str], as_of: dt.datetime,
                      params: FeatureParams = FeatureParams()) -> DataFrame:
    """AG-18: publication_rate_{3,6}m, avg_citation_count, avg_authors_per_paper,
    category_diversity_shannon, avg_abstract_length, avg/sum_keyword_count."""
    df = with_optional(df, {"published_date": "timestamp_ntz", "abstract": "string", "authors": "array<string>", "categories": "array<string>", "citation_count": "int"})
    kw = F.col("_kw")
    main = df.withColumn("_kw", keyword_count("abstract", params.keywords, params.stop_words)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[event_rate("published_date", as_of, m).alias(f"publication_rate_{m}m") for m in params.research_rate_months],
        F.coalesce(F.avg("citation_count"), F.lit(0.0)).alias("avg_citation_count"),
        F.coalesce(F.avg(F.when(F.col("authors").isNotNull(), F.size("authors"))), F.lit(0.0)).alias("avg_authors_per_paper"),
        F.avg(F.length(F.coalesce(F.col("abstract"), F.lit("")))).alias("avg_abstract_length"),
        F.avg(kw).alias("avg_keyword_count"),
        F.sum(kw).alias("sum_keyword_count"),
    ).where(F.col("_n") > 0).drop("_n")
    div = shannon_diversity(df, keys, "categories", explode=True, name="category_diversity_shannon",
                            eps=params.shannon_epsilon)
    out = _fill0(join_keys(main, div, keys), ["category_diversity_shannon"])
    cols = ([f"publication_rate_{m}m" for m in params.research_rate_months]
            + ["avg_citation_count", "avg_authors_per_paper", "category_diversity_shannon",
               "avg_abstract_length", "avg_keyword_count", "sum_keyword_count"])
    return out.select(*keys, *cols)
