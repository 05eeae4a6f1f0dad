"""Emergence scores, ranking and signals (EM-1..5, TK-1, TK-3, TK-4).

Input is one row per sector (latest features), so every step is a
per-row expression or a global aggregate over a sector-sized table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions.scalars import bands, fixed, row_mean
from trendspark.params import EmergenceParams


def score(df: DataFrame, params: EmergenceParams = EmergenceParams()) -> Column:
    """EM-1: Σ feature·weight over the scored indicators; a missing feature
    (or null value) counts 0."""
    total = F.lit(0.0)
    for indicator, feature in params.indicator_features.items():
        w = float(params.indicator_weights.get(indicator, 0.0))
        if feature in df.columns:
            total = total + F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) * F.lit(w)
    return total


def emerging(scored: DataFrame, sector_col: str, percentile: float) -> DataFrame:
    """EM-2: threshold = percentile of the positive scores, or their max when
    there are fewer than 100/(100 − p) of them (or p ≥ 100), 0 if none;
    keep score ≥ threshold and > 0, best first."""
    pos = F.col("emergence_score") > 0
    n_pos = F.count_if(pos)
    mx = F.max(F.when(pos, F.col("emergence_score")))
    if percentile >= 100:
        thr = F.coalesce(mx, F.lit(0.0))
    else:
        need = 100.0 / (100.0 - percentile)
        pct = F.percentile(F.when(pos, F.col("emergence_score")), F.lit(percentile / 100.0))
        thr = F.when((n_pos == 0) | (n_pos < F.lit(need)), F.coalesce(mx, F.lit(0.0))).otherwise(pct)
    threshold = scored.agg(thr.alias("threshold"))  # one row
    return (scored.crossJoin(F.broadcast(threshold))
            .where((F.col("emergence_score") >= F.col("threshold")) & pos)
            .withColumn("is_above_threshold", F.lit(True)))


def _pretty(name: str) -> str:
    return name.replace("_", " ").title()


def signals(df: DataFrame, params: EmergenceParams = EmergenceParams(),
            indicator_weights: dict[str, float] | None = None) -> DataFrame:
    """EM-3..5 on rows carrying ``emergence_score`` and features:
    key_indicators (top 3 positive value·weight, else fallback text),
    timeline_estimate, confidence_level and risk_factors (at most 2)."""
    weights = params.indicator_weights if indicator_weights is None else indicator_weights
    s = F.col("emergence_score")
    items = []
    for pos, (name, w) in enumerate(weights.items()):
        if name not in df.columns:
            continue  # an indicator is looked up as a column by name; absent → no contribution
        v = F.col(name).cast("double")
        items.append(F.when(v > 0, F.struct(
            (-(v * F.lit(float(w)))).alias("neg"), F.lit(pos).alias("pos"),
            F.concat(F.lit(_pretty(name)), F.lit(" (Value: "), fixed(v, 2), F.lit(", Contribution: "),
                     fixed(v * F.lit(float(w)), 2), F.lit(")")).alias("text"),
            (v * F.lit(float(w))).alias("contrib"))))
    if items:
        contrib = F.filter(F.array_sort(F.array_compact(F.array(*items))), lambda x: x["contrib"] > 0)
        top = F.transform(F.slice(contrib, 1, 3), lambda x: x["text"])
    else:
        top = F.array().cast("array<string>")
    fallback = F.when(s > 0, F.array(F.concat(F.lit("Overall positive momentum (Score: "), fixed(s, 2), F.lit(")")))) \
        .otherwise(F.array(F.lit("No specific strong positive indicators found.")))
    key_ind = F.when(F.size(top) > 0, top).otherwise(fallback)
    timeline = bands(s, [(params.timeline_fast, "0-1 year"), (params.timeline_medium, "1-2 years")], "2-3+ years")
    confidence = bands(s, [(params.confidence_high, "High"), (params.confidence_medium, "Medium")], "Low")

    def family_threshold(tag: str) -> Column:
        cols = [c for c in df.columns if tag in c]
        if not cols:
            return F.lit(params.family_default_threshold)
        return row_mean(cols) * F.lit(params.family_factor)

    def below(feature: str, tag: str) -> Column:
        v = F.col(feature).cast("double") if feature in df.columns else F.lit(0.0)
        return F.coalesce(v < family_threshold(tag), F.lit(False))

    risks = F.array_compact(F.array(
        F.when(below("funding_deals_velocity_3m_funding", "_funding"), F.lit(params.risk_low_funding)),
        F.when(below("publication_rate_3m_research", "_research"), F.lit(params.risk_low_research)),
        F.when(below("filing_rate_3m_patent", "_patent"), F.lit(params.risk_low_patent))))
    risks = F.when((F.size(risks) == 0) & (confidence != "High"), F.array(F.lit(params.risk_nascent))).otherwise(risks)
    risks = F.when(F.size(risks) > 2, F.slice(F.array_distinct(risks), 1, 2)).otherwise(risks)
    return df.select("*", key_ind.alias("key_indicators"), timeline.alias("timeline_estimate"),
                     confidence.alias("confidence_level"), risks.alias("risk_factors"))
