"""Tree ensembles per sector as grouped tasks (ML-1 .. ML-4, TK-6, FLT-11).

Every (sector, model, group of grid points, fold) is a group of rows: Spark
deals the groups out, each is fitted and scored in one task, the scores are
averaged, the best point of each (sector, model) is fitted again on all the
sector's rows, and the models come back as the rows of a table. Nothing but
the names of features is on the driver. The whole grids are searched, all 16
points of either model. A group is a sector's months, so it is bounded by the
calendar; sectors, points and folds are what grows, and they are spread.

Models are kept as a table in a folder named by a digest of the training rows,
the columns and the search, so equal trainings are done once.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.operators import timeseries as ts
from trendspark.operators import trees
from trendspark.operators.common import join_keys
from trendspark.params import GridParams
from trendspark.plans.training import TARGET, K
from trendspark.session import ensure_checkpoint_dir, materialize, ship_package
from trendspark.sources.scan import load_or_build

MODELS = (f"{K} string, model string, best_params string, cv_mae double, n_rows long, status string, error string, "
          "features array<string>, importances array<double>, ensemble binary")
SCORES = f"{K} string, model string, place int, mae double, error string"


def point_groups(grid: tuple[dict, ...]) -> list[list[int]]:
    """Positions of grid points that differ in their number of trees alone."""
    groups: dict[str, list[int]] = {}
    for i, point in enumerate(grid):
        rest = json.dumps({k: v for k, v in point.items() if k != "n_estimators"}, sort_keys=True)
        groups.setdefault(rest, []).append(i)
    return list(groups.values())


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups dealt to a fixed number of tasks: they are small but slow, so
    they must not be put together by their size."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _xy(rows: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values(ts.TS, kind="stable")
    return rows[features].to_numpy(float), rows[TARGET].to_numpy(float)


def _train(data: DataFrame, features: list[str], params: GridParams) -> DataFrame:
    spark = data.sparkSession
    grids = {trees.FOREST: params.forest, trees.BOOSTING: params.boosting}
    groups = {name: point_groups(grid) for name, grid in grids.items()}
    sizes = data.groupBy(K).agg(F.count(F.lit(1)).alias("n_rows"))
    enough = join_keys(data, sizes.where(F.col("n_rows") >= params.min_samples), [K], "inner")

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sector, name, group, _ = key
        places = groups[name][group]
        points = [grids[name][i] for i in places]
        try:
            x, y = _xy(rows[rows["role"] == "train"], features)
            model = trees.fit(name, max(points, key=lambda p: p["n_estimators"]), x, y, params.seed)
            found, error = trees.staged_errors(model, [p["n_estimators"] for p in points], *_xy(rows[rows["role"] == "test"], features)), None
        except Exception as e:  # noqa: BLE001 - a failing fit is recorded, the others go on
            found, error = [None] * len(places), str(e)
        return pd.DataFrame({K: sector, "model": name, "place": np.array(places, np.int32), "mae": pd.Series(found, dtype=float), "error": error})

    def refit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sector, name = key
        place, mae, n = rows["place"].iloc[0], rows["mae"].iloc[0], len(rows)
        out = {K: sector, "model": name, "best_params": None, "cv_mae": None, "n_rows": n, "status": "FAILED", "error": rows["error"].iloc[0],
               "features": features, "importances": None, "ensemble": None}
        if pd.notna(mae):
            try:
                point = grids[name][int(place)]
                model = trees.fit(name, point, *_xy(rows, features), params.seed)
                out |= {"best_params": json.dumps(point, sort_keys=True), "cv_mae": float(mae), "status": "OK", "error": None,
                        "importances": model.importances.tolist(), "ensemble": model.to_bytes()}
            except Exception as e:  # noqa: BLE001
                out["error"] = str(e)
        return pd.DataFrame([out])

    # the search space: a row per model and group of points
    space = spark.createDataFrame([(name, g) for name in grids for g in range(len(groups[name]))], "model string, place_group int")
    folds = ts.expanding_folds(enough.drop("n_rows"), [K], params.n_folds).crossJoin(F.broadcast(space))
    keys = [K, "model", "place_group", "fold"]
    scores = materialize(_spread(folds, keys).groupBy(*keys).applyInPandas(score, SCORES), "training-scores")
    means = scores.groupBy(K, "model", "place").agg(F.avg("mae").alias("mae"), F.max("error").alias("error"))
    # without a finite score the error stands in its place
    order = F.struct(F.coalesce(F.nanvl("mae", F.lit(float("inf"))), F.lit(float("inf"))), F.col("place"))
    best = means.groupBy(K, "model").agg(F.min_by(F.struct("place", "mae", "error"), order).alias("b")).select(K, "model", "b.*")
    models = _spread(join_keys(enough.drop("n_rows"), best, [K], "inner"), [K, "model"]).groupBy(K, "model").applyInPandas(refit, MODELS)
    none = {c: F.lit(None) for c in ("model", "best_params", "cv_mae", "error", "features", "importances", "ensemble")}
    small = sizes.where(F.col("n_rows") < params.min_samples).withColumns(none).withColumn("status", F.lit("SKIPPED_MIN_SAMPLES"))
    schema = spark.createDataFrame([], MODELS).schema
    return models.unionByName(small.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))


def train_models(train: DataFrame, params: GridParams = GridParams(), store: str | None = None) -> DataFrame:
    """ML-3 as a table, a row per sector and model (see MODELS). Sectors with
    fewer than ``min_samples`` rows are a row without a model; a null sector is
    a sector; a failing fit is a row with its error. ``store``: folder in which
    equal trainings are found again."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    features = [c for c in ts.numeric_columns(train) if c != TARGET]
    data = materialize(train.select(K, ts.TS, *[F.col(c).cast("double").alias(c) for c in [*features, TARGET]]).where(F.col(TARGET).isNotNull()), "training-rows")
    if store is None:
        return materialize(_train(data, features, params), "trained-models")
    sums = [F.sum(F.xxhash64(F.lit(seed), *data.columns).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    rows = data.agg(F.count(F.lit(1)).cast("string").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    key = hashlib.sha256(json.dumps([list(rows), data.columns, vars(params)], sort_keys=True, default=str).encode()).hexdigest()
    return load_or_build(spark, f"{store.rstrip('/')}/{key}", lambda: _train(data, features, params))


def predictions(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Long predictions (sector, ts, model, prediction) of every model on its
    own sector's rows: the two meet by sector, features are taken by name."""
    first = models.where(F.col("ensemble").isNotNull()).select("features").first()
    features = list(first["features"]) if first else []
    lost = [c for c in features if c not in rows.columns]
    if lost:
        raise ValueError(f"rows lack features the models were fitted on: {lost}")
    ship_package(rows.sparkSession)
    names = [f"f{i}" for i in range(len(features))]
    wanted = rows.select(K, ts.TS, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)])

    def one(key: tuple, mine: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        x, parts = mine[names].to_numpy(float), []
        for name, raw in zip(of["model"], of["ensemble"]):
            parts.append(pd.DataFrame({K: key[0], ts.TS: mine[ts.TS], "model": name, "prediction": trees.Ensemble.from_bytes(raw).predict(x)}))
        return pd.concat(parts) if parts and len(mine) else pd.DataFrame({K: [], ts.TS: [], "model": [], "prediction": []})
    fitted = models.where(F.col("ensemble").isNotNull()).select(K, "model", "ensemble")
    kind = rows.schema[ts.TS].dataType.simpleString()
    return wanted.groupBy(K).cogroup(fitted.groupBy(K)).applyInPandas(one, f"{K} string, {ts.TS} {kind}, model string, prediction double")


def importances(models: DataFrame) -> DataFrame:
    """ML-4, TK-6: importances as a long table, ranked per sector and model."""
    long = models.where(F.col("ensemble").isNotNull()).select(K, "model", F.explode(F.arrays_zip("features", "importances")).alias("x"))
    long = long.select(K, "model", F.col("x.features").alias("feature"), F.col("x.importances").alias("importance"))
    w = Window.partitionBy(K, "model").orderBy(F.col("importance").desc(), "feature")  # a row a feature
    return long.withColumn("rank", F.row_number().over(w))
