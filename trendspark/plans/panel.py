"""Sector × month panels, the aligned panel, the training table and the
history table (WN-13, WN-14, WN-15, EX-1, EX-2).

The raw record sets are reduced once to (sector, month) rows by a partial
aggregate; everything after that works on the bounded panel.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.functions.scalars import is_domestic
from trendspark.operators import timeseries as ts
from trendspark.operators.common import join_keys
from trendspark.operators.features import funding_features, patent_features, research_features
from trendspark.params import DOMESTIC_SOURCES, FeatureParams
from trendspark.session import ensure_checkpoint_dir, materialize

K = ["sector_label"]
TS = ts.TS
LAGS = (1, 3, 6, 12)

# Feature definitions of the three monthly panels (trailing months before ts).
PATENT_PANEL = [ts.Trailing("filing_rate_3m", "n", 3), ts.Trailing("filing_rate_6m", "n", 6),
                ts.Trailing("filing_rate_12m", "n", 12),
                ts.Trailing("international_share_12m", "intl", 12, "n")]
FUNDING_PANEL = [ts.Trailing("funding_deals_velocity_3m", "n", 3), ts.Trailing("funding_deals_velocity_6m", "n", 6),
                 ts.Trailing("funding_amount_velocity_3m_usd", "amount", 3),
                 ts.Trailing("funding_amount_velocity_6m_usd", "amount", 6),
                 ts.Trailing("avg_round_size_6m_usd", "amount", 6, "n")]
RESEARCH_PANEL = [ts.Trailing("publication_rate_3m", "n", 3), ts.Trailing("publication_rate_6m", "n", 6),
                  ts.Trailing("avg_citation_count_6m", "cites", 6, "n")]


def _spine_from(df: DataFrame, date_col: str, end: dt.datetime) -> DataFrame:
    bounds = df.agg(ts.month_floor(F.min(date_col)).alias("_start"))
    return ts.month_spine(df.sparkSession, "_start", end, bounds=bounds)


def _spine_from_monthly(monthly_df: DataFrame, end: dt.datetime) -> DataFrame:
    """Month spine from the first month of a monthly aggregate. Deriving the
    bounds (and the groups) from the same aggregate lets every use share one
    shuffle of it, so the raw records are scanned once per panel."""
    bounds = monthly_df.agg(F.min(TS).alias("_start"))
    return ts.month_spine(monthly_df.sparkSession, "_start", end, bounds=bounds)


def patent_monthly(p: DataFrame) -> DataFrame:
    return ts.monthly(p, K, "filing_date", {"n": F.count(F.lit(1)),
                                            "intl": F.count_if(~is_domestic("source", DOMESTIC_SOURCES))})


def funding_monthly(f: DataFrame) -> DataFrame:
    return ts.monthly(f, K, "date", {"n": F.count(F.lit(1)), "amount": F.sum("amount_usd")})


def research_monthly(r: DataFrame) -> DataFrame:
    return ts.monthly(r, K, "published_date", {"n": F.count(F.lit(1)), "cites": F.sum("citation_count")})


def patent_panel(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF) -> DataFrame:
    m = patent_monthly(B.patents(spark, sf))
    return ts.trailing_panel(m, K, _spine_from_monthly(m, end), PATENT_PANEL)


def funding_panel(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF) -> DataFrame:
    m = funding_monthly(B.funding(spark, sf))
    return ts.trailing_panel(m, K, _spine_from_monthly(m, end), FUNDING_PANEL)


def research_panel(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF) -> DataFrame:
    m = research_monthly(B.papers(spark, sf))
    return ts.trailing_panel(m, K, _spine_from_monthly(m, end), RESEARCH_PANEL)


def targets(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF) -> DataFrame:
    """EX-2: six-month growth of the monthly deal count, up to the last month
    that is complete at ``end`` (a month in progress is no target)."""
    m = funding_monthly(B.funding(spark, sf))
    complete = end.replace(day=1, hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=1)
    return ts.growth_target(m, K, _spine_from_monthly(m, complete), "n", 6, "target_growth_6m")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("target_growth_6m",)) -> list[str]:
    return [c for c in df.columns if c not in K + [TS] and c not in exclude]


def aligned_panel(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF) -> DataFrame:
    """WN-13: suffix, full outer join of the three panels, inner join with the
    target, forward then backward fill per sector."""
    frames = [ts.suffixed(patent_panel(spark, sf, end), K, "_patent"),
              ts.suffixed(funding_panel(spark, sf, end), K, "_funding"),
              ts.suffixed(research_panel(spark, sf, end), K, "_research")]
    merged = join_keys(ts.outer_align(frames, K), targets(spark, sf, end), K + [TS], "inner")
    return ts.ffill_bfill(merged, K, feature_columns(merged))


def training_table(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF,
                   lags: tuple[int, ...] = LAGS) -> DataFrame:
    """WN-14: aligned → z-score per sector (population std) → lags →
    median fill per sector → drop rows still incomplete."""
    # the aligned panel is sectors × months (bounded); a reliable checkpoint
    # cuts its long lineage so the optimizer does not re-derive it per step
    ensure_checkpoint_dir(spark)
    aligned = aligned_panel(spark, sf, end).checkpoint(eager=True)
    feats = feature_columns(aligned)
    scaled = ts.zscore(aligned, K, feats)
    with_lags = ts.lagged(scaled, K, feats, lags)
    all_feats = feature_columns(with_lags)
    filled = ts.median_impute(with_lags, K, all_feats)
    table = ts.drop_incomplete(filled, all_feats + ["target_growth_6m"], "any")
    # written once (bounded: sectors × months); fits and folds read the table
    return materialize(table, "training-table")


def history_table(spark: SparkSession, sf: str, end: dt.datetime = B.AS_OF, params: FeatureParams = FeatureParams()) -> DataFrame:
    """WN-15: target rows + as-of latest funding round (JN-3) + the one-row
    whole-table features of patents, funding and research repeated over all
    rows (JN-7) + median fill of numbers, 'Unknown' for text, drop rows without
    target or without any feature."""
    f = B.funding(spark, sf)
    tg = targets(spark, sf, end)
    spine = _spine_from(f, "date", end)
    last_round = ts.asof_monthly(f, K, "date", ["amount_usd", "stage"], spine, tie=["row_key"])
    last_round = last_round.select(*K, TS, F.col("amount_usd").alias("last_round_usd"),
                                   F.col("stage").alias("last_stage"))
    whole = (ts.suffixed(patent_features(B.patents(spark, sf), keys=[], as_of=end, params=params), [], "_patent"),
             ts.suffixed(funding_features(f, keys=[], as_of=end, params=params), [], "_funding"),
             ts.suffixed(research_features(B.papers(spark, sf), keys=[], as_of=end, params=params), [], "_research"))
    hist = join_keys(tg, last_round, K + [TS], "left")
    for one_row in whole:  # an aggregate without keys
        hist = hist.crossJoin(F.broadcast(one_row))
    numeric = [c for c in ts.numeric_columns(hist) if c != "target_growth_6m"]
    hist = ts.median_impute(hist, K, numeric).fillna("Unknown", subset=["last_stage"])
    hist = hist.dropna(subset=["target_growth_6m"]).dropna(how="all", subset=numeric + ["last_stage"])
    return hist
