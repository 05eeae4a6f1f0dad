"""Investment attractiveness and the ranked opportunity table (IV-1..3, TK-2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions.scalars import fixed, percent
from trendspark.operators.common import join_keys
from trendspark.params import InvestmentParams


def attractiveness(df: DataFrame, p: InvestmentParams = InvestmentParams(), sector_col: str = "sector",
                   growth: str = "expected_growth", quality: str = "quality_score",
                   market: str = "market_size_usd") -> DataFrame:
    """IV-1/IV-2: raw score, driver texts, risk texts and action per row."""
    g = F.coalesce(F.col(growth).cast("double"), F.lit(0.0))
    q = F.coalesce(F.col(quality).cast("double"), F.lit(0.0))
    m = F.coalesce(F.col(market).cast("double"), F.lit(0.0))
    score = (g * p.growth_potential + q * p.confidence_score + (m / 1e9) * p.market_size + F.lit(p.risk_adjusted_return))
    millions = fixed(m / 1e6, 0)
    drivers = F.array_compact(F.array(
        F.when(g >= p.high_growth_threshold, F.concat(F.lit("Strong Growth Potential ("), percent(g), F.lit(")")))
        .when(g > 0, F.concat(F.lit("Moderate Growth Potential ("), percent(g), F.lit(")")))
        .otherwise(F.concat(F.lit("Low/Negative Growth ("), percent(g), F.lit(")"))),
        F.when(q >= p.confidence_high, F.lit("High Prediction Confidence")),
        F.when(m >= p.large_market_threshold_usd, F.concat(F.lit("Large Market Size ($"), millions, F.lit("M)")))
        .when(m > 0, F.concat(F.lit("Market Size ($"), millions, F.lit("M)")))))
    risks = F.array_compact(F.array(
        F.when(q < p.confidence_low, F.lit("Very Low Prediction Confidence"))
        .when(q < p.confidence_medium, F.lit("Medium/Low Prediction Confidence")),
        F.when((m < p.min_market_size_threshold_usd) & (m > 0),
               F.concat(F.lit("Niche or Potentially Small Market ($"), millions, F.lit("M)")))
        .when((m == 0) & (F.col(sector_col) != "Emerging Technology"), F.lit("Market Size Unknown/Unverified")),
        F.when(g < p.low_growth_threshold, F.concat(F.lit("Low or Negative Growth Forecast ("), percent(g), F.lit(")")))))
    risks = F.when(F.size(risks) == 0, F.array(F.lit("Standard market and execution risks apply."))).otherwise(risks)
    # the action's confidence bar is the configured 'high' confidence threshold
    action = (F.when((score > p.action_invest_score_thresh) & (g > p.action_invest_growth_thresh)
                     & (q >= p.confidence_high), F.lit("Consider Investment"))
              .when((score > p.action_monitor_score_thresh) & (g > 0), F.lit("Monitor Closely"))
              .otherwise(F.lit("Monitor")))
    return df.select("*", score.alias("attractiveness_score"), drivers.alias("key_drivers"),
                     risks.alias("risk_assessment"), action.alias("recommended_action"))


def opportunities(summary: DataFrame, emerging: DataFrame, market: DataFrame,
                  p: InvestmentParams = InvestmentParams()) -> DataFrame:
    """IV-3: established rows (summary-horizon forecast with quality ≥ low,
    market size joined, 0 when unknown) plus emerging rows, best first.
    Mixed fields are split: expected_growth (double) + expected_growth_label,
    prediction_confidence_score (double) + prediction_confidence_label."""
    est = (summary.where(F.col("quality_score") >= p.confidence_low)
           .withColumnRenamed("sector_label", "sector"))
    # market has one row per sector: AQE broadcasts it when its measured size is small
    est = join_keys(est, market.withColumnRenamed("sector_label", "sector"), ["sector"], "left")
    est = attractiveness(est.withColumn("expected_growth", F.col("prediction")), p)
    est = est.select(
        F.lit("Established Sector").alias("type"), "sector",
        F.regexp_extract("horizon_key", r"^([^_]*)", 1).alias("horizon_analyzed"),
        F.col("expected_growth").cast("double"), F.lit(None).cast("string").alias("expected_growth_label"),
        F.col("quality_score").cast("double").alias("prediction_confidence_score"),
        F.lit(None).cast("string").alias("prediction_confidence_label"),
        "attractiveness_score", "key_drivers", "risk_assessment", "recommended_action")
    emg = emerging.select(
        F.lit("Emerging Technology").alias("type"), F.col("sector_label").alias("sector"),
        F.col("timeline_estimate").alias("horizon_analyzed"),
        F.lit(None).cast("double").alias("expected_growth"), F.lit("High Potential").alias("expected_growth_label"),
        F.lit(None).cast("double").alias("prediction_confidence_score"),
        F.col("confidence_level").alias("prediction_confidence_label"),
        F.col("emergence_score").alias("attractiveness_score"),
        F.col("key_indicators").alias("key_drivers"), F.col("risk_factors").alias("risk_assessment"),
        F.lit("Monitor for Early Investment").alias("recommended_action"))
    out = est.unionByName(emg)
    return out.orderBy(F.col("attractiveness_score").desc(), "type", "sector")

