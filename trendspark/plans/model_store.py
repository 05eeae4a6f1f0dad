"""A store of fitted models (PRJ-6, FC-1, FLT-12).

Models are saved with MLlib's writer under ``{path}/models/{key}``; a registry
table (Parquet, appended to) names each by sector, model, search space and a
fingerprint of the training rows, with its best parameters, score, feature
order and importances. The key is a digest of what the fit depends on, so a
model is found again only for the same rows, columns and search, and a save is
repeated harmlessly. A model is written before its registry row: a job that
dies in between leaves a file nobody looks for, never a row without a model.
"""
from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.sources.scan import path_exists

REGISTRY_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("sector_label", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("best_params", T.StringType()),
    T.StructField("cv_mae", T.DoubleType()), T.StructField("n_rows", T.LongType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("importances", T.ArrayType(T.DoubleType()))])

# FIXED VALUES: outcomes of a look-up.
FOUND, MISSING, OTHER_FEATURES = "OK", "MISSING", "OTHER_FEATURES"


@dataclass(frozen=True)
class Stored:
    """A look-up's outcome; ``model`` is None unless the status is FOUND."""
    status: str
    model: PipelineModel | None = None
    best_params: dict | None = None
    cv_mae: float | None = None
    n_rows: int | None = None
    importances: tuple[float, ...] = ()


def fingerprints(rows: DataFrame, key: str, columns: list[str]) -> dict:
    """Per group of ``key`` (null is a group): count and an order-free digest
    of the group's rows (two sums of 64-bit hashes); one aggregate, a row a
    group on the driver."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()
    return {r[key]: (r["n"], f"{r['n']}:{r['s0']}:{r['s1']}") for r in got}


def model_key(sector, model: str, search: dict, fingerprint: str, features: list[str]) -> str:
    """What a fit depends on, as one digest."""
    text = json.dumps([sector, model, search, fingerprint, features], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.registry_path = f"{self.path}/registry"

    def registry(self) -> DataFrame:
        """The latest row of every key (repeated saves write equal rows)."""
        if not path_exists(self.spark, self.registry_path):
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.registry_path).dropDuplicates(["key"])

    def save_model(self, key: str, model: PipelineModel) -> None:
        model.write().overwrite().save(f"{self.path}/models/{key}")

    def register(self, rows: list[tuple]) -> None:
        """Append registry rows (see REGISTRY_SCHEMA) of saved models."""
        if rows:
            self.spark.createDataFrame(rows, REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(self.registry_path)

    def rows(self, keys: list[str]) -> dict:
        """Registry rows of the keys that are there (a few metadata rows)."""
        return {r["key"]: r for r in self.registry().where(F.col("key").isin(keys)).collect()} if keys else {}

    def load(self, key: str, features: list[str], row=None) -> Stored:
        """The model of ``key``, if it is there and was fitted on ``features``
        in this order; a missing or other model is reported, not raised."""
        row = row if row is not None else self.rows([key]).get(key)
        path = f"{self.path}/models/{key}"
        if row is None or not path_exists(self.spark, f"{path}/metadata/_SUCCESS"):
            return Stored(MISSING)
        if list(row["features"]) != list(features):
            return Stored(OTHER_FEATURES)
        model = PipelineModel.load(path)
        if list(model.stages[0].getInputCols()) != list(features):
            return Stored(OTHER_FEATURES)
        return Stored(FOUND, model, json.loads(row["best_params"]), row["cv_mae"], row["n_rows"], tuple(row["importances"]))


def accepted(store: ModelStore, max_mae: float) -> DataFrame:
    """FLT-12's registry: sectors with a model within the acceptance limit."""
    return store.registry().where(F.col("cv_mae") <= F.lit(max_mae)).select("sector_label").distinct()
