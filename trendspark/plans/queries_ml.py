"""Registered training queries (ML-1..5, TK-6, FC-4 on tree models). Model fits
are not SQL-expressible: these have rows-only checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.operators import forecast as fc
from trendspark.operators import timeseries as ts
from trendspark.operators.common import join_keys
from trendspark.params import ForecastParams, GridParams
from trendspark.plans import grouped_training as GT
from trendspark.plans import panel as P
from trendspark.plans.registry import present, register
from trendspark.session import ensure_checkpoint_dir

K = ["sector_label"]


def _store(spark) -> str:
    """Fitted models of this application, shared by its queries."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/trendspark-models"


@register("train_sector_models")
def train_sector_models(spark, sf, params: GridParams = GridParams(), reuse: bool = True):
    """Fit on the chronological 70% of each sector, validate on the rest.
    ``reuse``: models already fitted on these rows are taken from the store."""
    split = ts.chrono_split(P.training_table(spark, sf), K, 0.7)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    models = GT.train_models(train, params, _store(spark) if reuse else None)
    metrics = fc.validation_metrics(GT.predictions(models, test), test, K, GT.TARGET, samples=3).select(
        *K, "model", F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"),
        F.col("direction_accuracy").alias("test_direction_accuracy"), "n_test",
        "predictions_sample", "actuals_sample")
    return present(join_keys(models.drop("features", "importances", "ensemble"), metrics, K + ["model"], "left"))


@register("feature_importances")
def feature_importances(spark, sf):
    return present(GT.importances(GT.train_models(P.training_table(spark, sf), GridParams(), _store(spark))))


@register("ml_sector_forecasts")
def ml_sector_forecasts(spark, sf):
    """Tree models fitted on every row, applied to each sector's latest row,
    combined with the configured 0.6 / 0.4 weights into forecasts."""
    table = P.training_table(spark, sf)
    models = GT.train_models(table, GridParams(), _store(spark))
    latest = ts.first_row(table.withColumn("_neg", -F.unix_micros(F.col(ts.TS).cast("timestamp"))), K, ["_neg"]).drop("_neg")
    p = ForecastParams()
    return present(fc.sector_forecasts(GT.predictions(models, latest), K, p.weights, p.horizons, p.quality_score, p.levels,
                                       generated_at=B.AS_OF))
