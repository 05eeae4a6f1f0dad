"""Per-sector tree ensembles (ML-1 .. ML-4, TK-6, FLT-11).

The training table is one row per (sector, month): small and bounded by the
calendar. Its rows and folds are written once as tables in the cluster's
checkpoint folder (``session.materialize``) and every fit reads those. Every
(sector, model, grid point, fold) fit and every refit is an independent
Spark job submitted from a small thread pool; MLlib parallelises each fit
over the partitions. Only sector names and fitted-model metadata live on the
driver. Folds are expanding windows (``timeseries.expanding_folds``);
MLlib's CrossValidator folds are random, so they are looped here.

Two things keep the number of fits down without dropping a grid point. Boosting
adds its trees one after another, so grid points that differ in their number of
stages alone are scored from one fit of the largest (``stage_groups``), and
only the best point is fitted again. And a ``ModelStore`` gives back what was
fitted before on the same rows with the same search. A fit reads one partition:
a sector's training rows are months, so they are bounded by the calendar, and
MLlib's time on them is the number of its small jobs.
"""
from __future__ import annotations

import json
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators import timeseries as ts
from trendspark.params import TrainParams
from trendspark.plans.model_store import FOUND, ModelStore, fingerprints, model_key
from trendspark.session import ensure_checkpoint_dir, materialize

log = logging.getLogger(__name__)
K = "sector_label"
TARGET = "target_growth_6m"


@dataclass
class SectorModels:
    """Fitted models and metadata per (sector, model name)."""
    features: list[str]
    models: dict = field(default_factory=dict)      # (sector, model) -> PipelineModel
    rows: list = field(default_factory=list)        # result rows
    importances: list = field(default_factory=list)


def _estimator(name: str, params: dict, seed: int):
    if name == "random_forest":
        return RandomForestRegressor(labelCol=TARGET, featuresCol="features", seed=seed, **params)
    return GBTRegressor(labelCol=TARGET, featuresCol="features", seed=seed, **params)


def _pipeline(features: list[str], name: str, params: dict, seed: int) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            _estimator(name, params, seed)])


def stage_groups(name: str, grid: tuple[dict, ...]) -> list[list[int]]:
    """Positions of grid points that one fit scores: boosting points equal but
    for ``maxIter`` are one group, any other point is its own."""
    if name != "gradient_boosting":
        return [[i] for i in range(len(grid))]
    groups: dict[str, list[int]] = {}
    for i, point in enumerate(grid):
        rest = json.dumps({k: v for k, v in point.items() if k != "maxIter"}, sort_keys=True)
        groups.setdefault(rest, []).append(i)
    return list(groups.values())


def _scores(model: PipelineModel, name: str, points: list[dict], test: DataFrame) -> list[float | None]:
    """Mean absolute error of every point of a group on ``test``, by the model
    of the group's largest point."""
    if name == "gradient_boosting" and len(points) > 1:
        by_stage = model.stages[-1].evaluateEachIteration(model.stages[0].transform(test), "absolute")
        return [float(by_stage[p["maxIter"] - 1]) for p in points]
    r = model.transform(test).agg(F.avg(F.abs(F.col("prediction") - F.col(TARGET)))).first()
    return [None if r is None else r[0]]


def _finite(v: float | None) -> bool:
    return v is not None and v == v


def train_sector_models(train: DataFrame, params: TrainParams = TrainParams(),
                        store: ModelStore | None = None) -> SectorModels:
    """ML-3: per sector with at least ``min_samples`` rows: grid search by
    mean MAE over expanding-window folds, refit of the best point on all the
    sector's rows, feature importances. A failing fit is recorded and skipped.
    With a ``store`` models fitted before on the same rows, columns and search
    are loaded, and the others are fitted and saved there."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    features = [c for c in ts.numeric_columns(train) if c != TARGET]
    data = materialize(train.select(K, ts.TS, *features, TARGET), "training-rows")
    seen = fingerprints(data, K, [ts.TS, *features, TARGET])
    counts = {sector: n for sector, (n, _) in seen.items()}
    out = SectorModels(features=features)
    grids = {"random_forest": params.rf_grid, "gradient_boosting": params.gbt_grid}
    groups = {name: stage_groups(name, grid) for name, grid in grids.items()}
    search = {"folds": params.n_folds, "seed": params.seed}

    eligible, known = [], []
    for sector in sorted(counts, key=str):
        if counts[sector] < params.min_samples:
            out.rows.append((sector, None, None, None, counts[sector], "SKIPPED_MIN_SAMPLES", None))
        else:
            eligible += [(sector, name) for name in grids]
    keys = {(sector, name): model_key(sector, name, search | {"grid": grids[name]}, seen[sector][1], features) for sector, name in eligible}

    def keep(sector, name, model, point, score, importances) -> None:
        out.models[(sector, name)] = model
        out.rows.append((sector, name, json.dumps(point, sort_keys=True), score, counts[sector], "OK", None))
        out.importances.extend((sector, name, features[i], float(v)) for i, v in enumerate(importances))

    with ThreadPoolExecutor(max_workers=max(1, params.parallelism)) as pool:
        if store is not None:
            rows = store.rows(list(keys.values()))
            wanted = [(task, rows[key]) for task, key in keys.items() if key in rows]
            for (task, _), found in zip(wanted, pool.map(lambda x: store.load(keys[x[0]], features, x[1]), wanted)):
                if found.status == FOUND:
                    known.append(task)
                    keep(*task, found.model, found.best_params, found.cv_mae, found.importances)
        todo = [task for task in eligible if task not in known]
        if not todo:
            return out
        folds = materialize(ts.expanding_folds(data, [K], params.n_folds), "training-folds")

        def cv(task):
            sector, name, group, f = task
            points = [grids[name][i] for i in groups[name][group]]
            try:
                fd = folds.where(F.col(K).eqNullSafe(F.lit(sector)) & (F.col("fold") == f))
                largest = max(points, key=lambda p: p.get("maxIter", 0))
                model = _pipeline(features, name, largest, params.seed).fit(fd.where(F.col("role") == "train").coalesce(1))
                return task, _scores(model, name, points, fd.where(F.col("role") == "test").coalesce(1)), None
            except Exception as e:  # noqa: BLE001 - a failing fit is recorded, the others go on
                return task, None, e

        def refit(task):
            sector, name, point, score = task
            try:
                model = _pipeline(features, name, point, params.seed).fit(data.where(F.col(K).eqNullSafe(F.lit(sector))).coalesce(1))
                if store is not None:
                    store.save_model(keys[sector, name], model)
                return task, model, model.stages[-1].featureImportances.toArray().tolist(), None
            except Exception as e:  # noqa: BLE001
                log.warning("training %s/%s failed: %s", sector, name, e)
                return task, None, [], e

        # every (sector, model, group of grid points, fold) fit is an independent small job; long fits first
        tasks = [(sector, name, g, f) for sector, name in todo for g in range(len(groups[name])) for f in range(params.n_folds)]
        tasks.sort(key=lambda t: t[1])
        scores: dict = {}
        for (sector, name, g, _f), got, err in pool.map(cv, tasks):
            if err is not None:
                log.warning("fold fit %s/%s failed: %s", sector, name, err)
            for i, mae in zip(groups[name][g], got or []):
                if _finite(mae):
                    scores.setdefault((sector, name, i), []).append(mae)
        refits = []
        for sector, name in todo:
            means = {i: sum(v) / len(v) for (s2, n2, i), v in scores.items() if s2 == sector and n2 == name and v}
            best = min(means, key=lambda i: (means[i], i)) if means else 0
            refits.append((sector, name, grids[name][best], means.get(best)))
        fresh = []
        for (sector, name, point, score), model, importances, err in pool.map(refit, refits):
            if model is None:
                out.rows.append((sector, name, None, None, counts[sector], "FAILED", str(err)))
                continue
            keep(sector, name, model, point, score, importances)
            fresh.append((keys[sector, name], sector, name, json.dumps(point, sort_keys=True), score, counts[sector], seen[sector][1], features,
                          [float(v) for v in importances]))
        if store is not None:
            store.register(fresh)
    return out


RESULT_SCHEMA = T.StructType([
    T.StructField(K, T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("best_params", T.StringType()), T.StructField("cv_mae", T.DoubleType()),
    T.StructField("n_rows", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType())])
IMPORTANCE_SCHEMA = T.StructType([
    T.StructField(K, T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])


def results_frame(spark: SparkSession, sm: SectorModels) -> DataFrame:
    return spark.createDataFrame(sm.rows, RESULT_SCHEMA)


def importances_frame(spark: SparkSession, sm: SectorModels) -> DataFrame:
    """ML-4 / TK-6: importances as a long table, ranked per (sector, model)."""
    from pyspark.sql import Window
    df = spark.createDataFrame(sm.importances, IMPORTANCE_SCHEMA)
    w = Window.partitionBy(K, "model").orderBy(F.col("importance").desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w))


def predict(sm: SectorModels, rows: DataFrame) -> DataFrame:
    """Long predictions (sector, ts, model, prediction) of every fitted model
    on its own sector's rows (one lazy union, one job). Features are taken by
    name in the order of the fit, whatever the columns' order in ``rows``."""
    lost = [c for c in sm.features if c not in rows.columns]
    if lost:
        raise ValueError(f"rows lack features the models were fitted on: {lost}")
    parts = []
    for (sector, name), model in sorted(sm.models.items(), key=str):
        sec = rows.where(F.col(K).eqNullSafe(F.lit(sector)))
        parts.append(model.transform(sec).select(K, ts.TS, F.lit(name).alias("model"), "prediction"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"{K} string, ts timestamp_ntz, model string, prediction double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
