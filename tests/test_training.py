"""Grids of the tree ensembles: full ones by default, small ones here only;
staged scoring of boosting; the store of fitted models."""
import datetime as dt
import json
import tempfile

import pytest

from trendspark.params import TrainParams
from trendspark.plans import model_store as MS
from trendspark.plans import training as TR

SMALL = TrainParams(rf_grid=({"numTrees": 2, "maxDepth": 2}, {"numTrees": 3, "maxDepth": 2}),
                    gbt_grid=({"maxIter": 2, "maxDepth": 1}, {"maxIter": 2, "maxDepth": 2}), n_folds=2)


def table(spark, sectors=("a",), n=30):
    rows = [(s, dt.datetime(2000 + i // 12, i % 12 + 1, 1), float(i), float(i % 7), float((i * 7 + k) % 5) + i / 10)
            for k, s in enumerate(sectors) for i in range(n)]
    return spark.createDataFrame(rows, f"{TR.K} string, {TR.ts.TS} timestamp_ntz, x double, y double, {TR.TARGET} double")


def test_default_grids_are_the_full_ones():
    p = TrainParams()
    rf = {(g["numTrees"], g["maxDepth"], g["minInstancesPerNode"]) for g in p.rf_grid}
    gbt = {(g["maxIter"], g["stepSize"], g["maxDepth"], g["subsamplingRate"]) for g in p.gbt_grid}
    assert rf == {(n, d, leaf) for n in (50, 100) for d in (5, 10) for leaf in (1, 2)} and len(p.rf_grid) == 8
    assert gbt == {(n, lr, d, ss) for n in (50, 100) for lr in (0.05, 0.1) for d in (3, 5) for ss in (0.8, 1.0)} and len(p.gbt_grid) == 16


def test_every_grid_point_is_searched(spark):
    sm = TR.train_sector_models(table(spark), SMALL)
    points = {r[1]: json.loads(r[2]) for r in sm.rows}
    assert points["random_forest"] in SMALL.rf_grid and points["gradient_boosting"] in SMALL.gbt_grid
    assert all(r[3] is not None and r[5] == "OK" for r in sm.rows)


def test_one_fit_scores_points_that_differ_in_stages():
    p = TrainParams()
    groups = TR.stage_groups("gradient_boosting", p.gbt_grid)
    assert sorted(i for g in groups for i in g) == list(range(16)) and sorted(map(len, groups)) == [2] * 8
    assert TR.stage_groups("random_forest", p.rf_grid) == [[i] for i in range(8)]


def test_first_stages_are_those_of_a_shorter_fit(spark):
    df = table(spark)
    train, test = df.where("x < 20").coalesce(1), df.where("x >= 20").coalesce(1)
    short, long = ({"maxIter": n, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 0.8} for n in (5, 11))
    a, b = (TR._pipeline(["x", "y"], "gradient_boosting", p, 42).fit(train) for p in (short, long))
    trees = [[t.toDebugString.split("\n", 1)[1] for t in m.stages[-1].trees] for m in (a, b)]
    assert len(trees[1]) == 11 and trees[1][:5] == trees[0]
    staged = TR._scores(b, "gradient_boosting", [short, long], test)
    alone = [TR._scores(m, "gradient_boosting", [p], test)[0] for m, p in ((a, short), (b, long))]
    assert staged == pytest.approx(alone, abs=1e-9)


def test_models_are_stored_found_and_checked(spark):
    path = tempfile.mkdtemp(prefix="trendspark-models-", dir="/tmp")
    df = table(spark, ("a", None, "b")).where(f"not ({TR.K} <=> 'b' and x > 5)")  # b: too few rows
    first = TR.train_sector_models(df, SMALL, MS.ModelStore(spark, path))
    assert {(r[0], r[5]) for r in first.rows} == {("a", "OK"), (None, "OK"), ("b", "SKIPPED_MIN_SAMPLES")}
    again = MS.ModelStore(spark.newSession(), path)
    assert again.registry().count() == 4
    fits = TR._pipeline
    TR._pipeline = None  # nothing is fitted the second time
    try:
        second = TR.train_sector_models(df, SMALL, again)
    finally:
        TR._pipeline = fits
    key = lambda rows: sorted(rows, key=str)
    assert key(first.rows) == key(second.rows) and key(first.importances) == key(second.importances)
    shuffled = df.select(TR.TARGET, "y", TR.ts.TS, "x", TR.K)
    a, b = (sorted(map(tuple, TR.predict(sm, rows).collect()), key=str) for sm, rows in ((first, df), (second, shuffled)))
    assert len(a) == 120 and a == b
    with pytest.raises(ValueError, match="lack"):
        TR.predict(second, df.drop("y"))
    # other rows are other models
    third = TR.train_sector_models(df.withColumn("x", TR.F.col("x") + 1), SMALL, again)
    assert len(third.models) == 4 and again.registry().count() == 8
    one = again.registry().first()
    assert again.load("no such key", ["x", "y"]).status == MS.MISSING
    assert again.load(one["key"], ["y", "x"]).status == MS.OTHER_FEATURES
    found = again.load(one["key"], ["x", "y"])
    assert found.status == MS.FOUND and found.n_rows == 30
    assert {r[0] for r in MS.accepted(again, 1e9).collect()} == {"a", None} and MS.accepted(again, -1.0).count() == 0
