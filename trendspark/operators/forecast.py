"""Predictions, ensemble, intervals and forecast tables (FC-1..5, ML-5, ML-6, AG-23).

Predictions are a long table ``(keys..., model, prediction)``; any model
may feed it (MLlib trees from ``plans.training``, or the closed-form
predictors below). Everything after that is a grouped aggregate over a
handful of rows per sector.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators.common import join_keys, ts_lit
from trendspark.operators.timeseries import TS, month_index

# ----------------------------------------------------------------------------
# Closed-form predictors (fit = one grouped aggregate)
# ----------------------------------------------------------------------------


def fit_trend_predictors(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Per group: least-squares trend of target on the month index, the mean
    and the last value, plus the last month index."""
    x = month_index(TS).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(target), x).alias("_slope"),
        F.regr_intercept(F.col(target), x).alias("_intercept"),
        F.avg(target).alias("_mean"),
        F.max_by(F.col(target), F.col(TS)).alias("_last"),
        F.max(x).alias("_last_mi"))


TREND_MODELS = ("linear_trend", "train_mean", "last_value")


def predict_trend(fits: DataFrame, rows: DataFrame | None, keys: list[str]) -> DataFrame:
    """Long predictions. With ``rows`` (keys, ts): one prediction per row and
    model; without: one per group for the month after the last fitted month."""
    if rows is None:
        base = fits.withColumn("_x", F.col("_last_mi") + 1.0)
        ident = list(keys)
    else:
        base = join_keys(rows, fits, keys, "inner").withColumn("_x", month_index(TS).cast("double"))
        ident = list(keys) + [TS]
    preds = F.array(
        F.struct(F.lit("linear_trend").alias("model"),
                 (F.col("_intercept") + F.col("_slope") * F.col("_x")).alias("prediction")),
        F.struct(F.lit("train_mean").alias("model"), F.col("_mean").alias("prediction")),
        F.struct(F.lit("last_value").alias("model"), F.col("_last").alias("prediction")))
    return base.select(*ident, F.inline(preds))


# ----------------------------------------------------------------------------
# Ensemble and intervals
# ----------------------------------------------------------------------------


def weights_frame(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("weight", T.DoubleType())])
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], schema)


def ensemble(preds: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """FC-1: Σ w·p / Σ w over non-null predictions whose model has a weight;
    no weight at all → plain mean of the non-null predictions; all null →
    null. The weight table is the configured map (bounded), broadcast."""
    w = F.broadcast(weights_frame(preds.sparkSession, weights))
    j = preds.join(w, on="model", how="left")
    has = F.col("prediction").isNotNull() & F.col("weight").isNotNull()
    wsum = F.sum(F.when(has, F.col("weight")))
    wp = F.sum(F.when(has, F.col("weight") * F.col("prediction")))
    value = F.when(F.coalesce(wsum, F.lit(0.0)) != 0, wp / wsum).otherwise(F.avg("prediction"))
    return j.groupBy(*keys).agg(value.alias("prediction"),
                                F.count("prediction").alias("n_models"))


def intervals(preds: DataFrame, keys: list[str], levels: tuple[float, ...] = (0.68, 0.95)) -> DataFrame:
    """FC-2: percentiles of the model predictions (linear interpolation);
    fewer than 2 non-null predictions → null bounds. Columns
    ``ci{level}_low`` / ``ci{level}_high`` with level as an integer percent."""
    qs = []
    for lv in levels:
        a = 1.0 - lv
        qs += [a / 2.0, 1.0 - a / 2.0]
    pct = F.percentile(F.col("prediction"), F.array(*[F.lit(q) for q in qs]))
    agg = preds.where(F.col("prediction").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), pct.alias("_p"))
    cols = []
    for i, lv in enumerate(levels):
        tag = int(round(lv * 100))
        cols += [F.when(F.col("_n") >= 2, F.col("_p")[2 * i]).alias(f"ci{tag}_low"),
                 F.when(F.col("_n") >= 2, F.col("_p")[2 * i + 1]).alias(f"ci{tag}_high")]
    return agg.select(*keys, *cols)


def sector_forecasts(preds: DataFrame, keys: list[str], weights: dict[str, float],
                     horizons: tuple[int, ...], quality: float = 0.75,
                     levels: tuple[float, ...] = (0.68, 0.95), generated_at=None) -> DataFrame:
    """FC-4: one row per (group, horizon); the same ensemble value for every
    horizon (the predictors do not take a horizon), key ``{h}m_growth_rate``;
    groups whose ensemble is null are skipped."""
    ens = ensemble(preds, keys, weights).where(F.col("prediction").isNotNull())
    ci = intervals(preds, keys, levels)
    hz = F.explode(F.array(*[F.struct(F.lit(i).alias("horizon_pos"), F.lit(int(h)).alias("horizon_months"))
                             for i, h in enumerate(horizons)]))
    out = join_keys(ens, ci, keys, "left").select("*", hz.alias("_h")).select(
        *keys, "_h.horizon_pos", "_h.horizon_months",
        F.concat(F.col("_h.horizon_months").cast("string"), F.lit("m_growth_rate")).alias("horizon_key"),
        "prediction", *[c for c in ci.columns if c not in keys],
        F.lit(float(quality)).alias("quality_score"))
    if generated_at is not None:  # the job's as-of time, passed in (never the clock)
        out = out.withColumn("generated_at", ts_lit(generated_at))
    return out


def summary_horizon(forecasts: DataFrame, keys: list[str], preferred: int = 12) -> DataFrame:
    """FC-5: per group the preferred horizon when present, else the first
    requested one."""
    rank = F.when(F.col("horizon_months") == preferred, F.lit(-1)).otherwise(F.col("horizon_pos"))
    rest = [c for c in forecasts.columns if c not in keys]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), rank)
    return forecasts.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ----------------------------------------------------------------------------
# Validation metrics (ML-5)
# ----------------------------------------------------------------------------


def validation_metrics(preds: DataFrame, actuals: DataFrame, keys: list[str], target: str,
                       samples: int = 0) -> DataFrame:
    """MAE, RMSE and direction accuracy per (group, model); signs compare with
    nulls taken as 0. With ``samples`` > 0 also the first predictions and
    actuals in time order (test rows of a panel: bounded per group)."""
    j = join_keys(preds, actuals.select(*keys, TS, target), keys + [TS], "inner")
    err = F.col("prediction") - F.col(target)
    same = F.signum(F.coalesce(F.col(target), F.lit(0.0))) == F.signum(F.coalesce(F.col("prediction"), F.lit(0.0)))
    metrics = j.groupBy(*keys, "model").agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(same.cast("double")).alias("direction_accuracy"),
        F.count(F.lit(1)).alias("n_test"))
    if samples <= 0:
        return metrics
    # first rows in time order: a rank-limit filter keeps at most `samples` per group
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, "model").orderBy(TS)
    first = (j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= samples)
             .groupBy(*keys, "model")
             .agg(F.array_sort(F.collect_list(F.struct("_rn", "prediction", target))).alias("_s")))
    first = first.select(*keys, "model", F.transform("_s", lambda x: x["prediction"]).alias("predictions_sample"),
                         F.transform("_s", lambda x: x[target]).alias("actuals_sample"))
    return join_keys(metrics, first, keys + ["model"], "left")


# ----------------------------------------------------------------------------
# Weighted indices (AG-23, ML-6)
# ----------------------------------------------------------------------------


def weighted_mean(df: DataFrame, weights: dict[str, float]) -> Column:
    """Σ v·w / Σ w over the weighted columns present in ``df`` (null values
    count as 0, as a missing key does); 0 if no weighted column is present."""
    present = {c: w for c, w in weights.items() if c in df.columns}
    total = sum(present.values())
    if not present or total == 0:
        return F.lit(0.0)
    num = None
    for c, w in present.items():
        term = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
        num = term if num is None else num + term
    return num / F.lit(float(total))


def innovation_indices(features: DataFrame, keys: list[str], patent_w: dict, funding_w: dict, research_w: dict,
                       innovation=(0.40, 0.35, 0.25), readiness=(0.60, 0.40), momentum=(0.70, 0.30)) -> DataFrame:
    p, f, r = weighted_mean(features, patent_w), weighted_mean(features, funding_w), weighted_mean(features, research_w)
    scored = features.select(*keys, p.alias("patent_score"), f.alias("funding_score"), r.alias("research_score"))
    ps, fs, rs = F.col("patent_score"), F.col("funding_score"), F.col("research_score")
    return scored.select(
        *keys, "patent_score", "funding_score", "research_score",
        (innovation[0] * ps + innovation[1] * fs + innovation[2] * rs).alias("innovation_index"),
        (readiness[0] * fs + readiness[1] * ps).alias("commercial_readiness_index"),
        (momentum[0] * rs + momentum[1] * ps).alias("research_momentum_index"))
