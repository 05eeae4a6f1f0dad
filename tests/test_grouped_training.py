"""Tree ensembles as grouped tasks: the learner, the whole grids, staged
scoring, the store, predictions by feature name."""
import datetime as dt
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.operators import trees
from trendspark.params import GridParams
from trendspark.plans import grouped_training as GT

SMALL = GridParams(forest=tuple({"n_estimators": n, "max_depth": d, "min_samples_split": 2, "min_samples_leaf": 1} for n in (3, 6) for d in (1, 3)),
                   boosting=tuple({"n_estimators": n, "learning_rate": r, "max_depth": 2, "subsample": .8} for n in (4, 9) for r in (.1, .3)), n_folds=2)


def table(spark, sectors=("a",), n=30):
    rows = [(s, dt.datetime(2000 + i // 12, i % 12 + 1, 1), float(i), float(i % 7), float((i * 7 + k) % 5) + i / 10)
            for k, s in enumerate(sectors) for i in range(n)]
    return spark.createDataFrame(rows, f"{GT.K} string, {GT.ts.TS} timestamp_ntz, x double, y double, {GT.TARGET} double")


def test_default_grids_are_the_whole_ones():
    p = GridParams()
    forest = {(g["n_estimators"], g["max_depth"], g["min_samples_split"], g["min_samples_leaf"]) for g in p.forest}
    boosting = {(g["n_estimators"], g["learning_rate"], g["max_depth"], g["subsample"]) for g in p.boosting}
    assert forest == {(n, d, s, leaf) for n in (50, 100) for d in (5, 10) for s in (2, 5) for leaf in (1, 2)} and len(p.forest) == 16
    assert boosting == {(n, lr, d, ss) for n in (50, 100) for lr in (0.05, 0.1) for d in (3, 5) for ss in (0.8, 1.0)} and len(p.boosting) == 16
    for grid in (p.forest, p.boosting):
        groups = GT.point_groups(grid)
        assert sorted(i for g in groups for i in g) == list(range(16)) and sorted(map(len, groups)) == [2] * 8


def test_best_split_against_all_splits():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, d = rng.integers(2, 12), rng.integers(1, 4)
        x, y, w = rng.integers(0, 5, (n, d)).astype(float), rng.normal(size=n), rng.integers(1, 3, n).astype(float)
        leaf = int(rng.integers(1, 3))
        sse = lambda m: (w[m] * (y[m] - (w[m] * y[m]).sum() / w[m].sum()) ** 2).sum()
        options = []
        for f in range(d):
            for v in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= v
                if w[left].sum() >= leaf and w[~left].sum() >= leaf:
                    options.append(sse(np.ones(n, bool)) - sse(left) - sse(~left))
        got = trees.best_split(x, y, w, leaf)
        if got is None:
            assert not options or max(options) < 1e-9
        else:
            assert got[0] == pytest.approx(max(options))
            left = x[:, got[1]] <= got[2]
            assert sse(np.ones(n, bool)) - sse(left) - sse(~left) == pytest.approx(got[0])


def test_ensembles_learn_and_come_back():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 1] > 0, 3.0, -1.0) + x[:, 3]
    for name, point in ((trees.FOREST, {"n_estimators": 30, "max_depth": 6, "min_samples_split": 2, "min_samples_leaf": 1}),
                        (trees.BOOSTING, {"n_estimators": 60, "learning_rate": .1, "max_depth": 3, "subsample": .8})):
        m = trees.fit(name, point, x[:150], y[:150], 1)
        assert np.abs(m.predict(x[150:]) - y[150:]).mean() < .45
        assert m.importances.sum() == pytest.approx(1) and set(np.argsort(-m.importances)[:2]) == {1, 3}
        again = trees.Ensemble.from_bytes(m.to_bytes())
        assert np.array_equal(again.predict(x), m.predict(x))
        # the first trees are those of a smaller ensemble
        short = trees.fit(name, point | {"n_estimators": 10}, x[:150], y[:150], 1)
        assert np.array_equal(short.feature, m.feature[:len(short.feature)]) and np.array_equal(short.threshold, m.threshold[:len(short.threshold)])
        alone = float(np.abs(short.predict(x) - y).mean())
        assert trees.staged_errors(m, [10], x, y) == pytest.approx([alone])
    leaves = trees.fit(trees.FOREST, {"n_estimators": 1, "max_depth": 9, "min_samples_split": 2, "min_samples_leaf": 40}, x, y, 1)
    assert (leaves.feature < 0).sum() <= 5
    hole = x.copy()
    hole[::3, 1] = np.nan
    assert np.isfinite(trees.fit(trees.BOOSTING, {"n_estimators": 5, "learning_rate": .1, "max_depth": 3, "subsample": 1.0}, hole, y, 1).predict(hole)).all()


def test_grid_search_is_the_brute_force_one(spark):
    df = table(spark, ("a", None, "b")).where(f"not ({GT.K} <=> 'b' and x > 5)")  # b: too few rows
    got = {(r[GT.K], r.model): r for r in GT.train_models(df, SMALL).collect()}
    assert {(k, r.status) for k, r in got.items()} == {(("a", trees.FOREST), "OK"), (("a", trees.BOOSTING), "OK"), ((None, trees.FOREST), "OK"),
                                                       ((None, trees.BOOSTING), "OK"), (("b", None), "SKIPPED_MIN_SAMPLES")}
    for sector in ("a", None):
        rows = sorted((r for r in df.collect() if r[GT.K] == sector), key=lambda r: r.ts)
        x, y = np.array([[r.x, r.y] for r in rows]), np.array([r[GT.TARGET] for r in rows])
        t = len(rows) // (SMALL.n_folds + 1)
        for name, grid in ((trees.FOREST, SMALL.forest), (trees.BOOSTING, SMALL.boosting)):
            maes = []
            for point in grid:
                cuts = [len(rows) - (SMALL.n_folds - f) * t for f in range(SMALL.n_folds)]
                maes.append(np.mean([np.abs(trees.fit(name, point, x[:c], y[:c], SMALL.seed).predict(x[c:c + t]) - y[c:c + t]).mean() for c in cuts]))
            r = got[sector, name]
            assert json.loads(r.best_params) == grid[int(np.argmin(maes))] and r.cv_mae == pytest.approx(min(maes)) and r.n_rows == 30
            assert np.allclose(trees.Ensemble.from_bytes(r.ensemble).predict(x), trees.fit(name, json.loads(r.best_params), x, y, SMALL.seed).predict(x))


def test_models_are_found_again_and_predict_by_name(spark):
    path = tempfile.mkdtemp(prefix="trendspark-models-", dir="/tmp")
    df = table(spark, ("a", None))
    first = GT.train_models(df, SMALL, path)
    train = GT._train
    GT._train = None  # nothing is fitted the second time
    try:
        again = GT.train_models(df.select(*df.columns).orderBy("x"), SMALL, path)
    finally:
        GT._train = train
    key = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert key(first) == key(again)
    shuffled = df.select(GT.TARGET, "y", GT.ts.TS, "x", GT.K)
    a, b = key(GT.predictions(first, df)), key(GT.predictions(again, shuffled))
    assert len(a) == 120 and a == b
    with pytest.raises(ValueError, match="lack"):
        GT.predictions(first, df.drop("y"))
    assert GT.train_models(df.withColumn("x", F.col("x") + 1), SMALL, path).count() == 4
    ranks = GT.importances(first).where(f"{GT.K} = 'a' and model = '{trees.FOREST}'").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == [1, 2] and ranks[0].importance >= ranks[1].importance
    assert GT.train_models(df.limit(0), SMALL).count() == 0
