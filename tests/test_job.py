"""End-to-end job on the smallest tables: every output written, cached
inputs reused on a second run, status rows appended."""
import datetime as dt
import os
import tempfile

import pytest

from trendspark.operators import monitor as mo
from trendspark.operators import validate as V
from trendspark.params import TrainParams
from trendspark.plans import job
from trendspark.plans.job import run_job
from trendspark.plans.model_store import ModelStore
from trendspark.sources.conform import write_if_any

SF = "/root/testdata/sf0.001"


def test_run_job_writes_outputs_and_status(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    out = tempfile.mkdtemp(prefix="trendspark-job-", dir="/tmp")
    written = run_job(spark, SF, out)
    assert written["aligned_panel"] and written["sector_forecasts"] and written["maintenance_report"]
    assert spark.read.parquet(f"{out}/funding_features").count() == 5
    run_job(spark, SF, out)  # features are loaded, not rebuilt
    log = mo.read_status_log(spark, f"{out}/pipeline_status")
    assert log.count() == 10  # a run: started, three sources, completed
    assert {r.pipeline_name: r.status for r in mo.latest_status(log).collect()} == {
        "main_run": "COMPLETED", "patents_pipeline": "SUCCESS", "funding_pipeline": "SUCCESS", "research_pipeline": "SUCCESS"}
    # health is judged on that log, so the sector checks run
    report = spark.read.parquet(f"{out}/maintenance_report").collect()
    assert all(r.healthy and r.maintenance_status == "COMPLETED" and r.retrain == r.degraded for r in report)


def test_run_job_is_as_of_one_date(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    out = tempfile.mkdtemp(prefix="trendspark-job-", dir="/tmp")
    as_of = dt.datetime(2000, 9, 1)
    run_job(spark, SF, out, as_of=as_of)
    last = spark.read.parquet(f"{out}/aligned_panel").agg({"ts": "max"}).first()[0]
    assert last < as_of
    assert {r[0] for r in spark.read.parquet(f"{out}/sector_forecasts").select("generated_at").distinct().collect()} == {as_of}


def test_records_are_validated_with_their_write(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    out = tempfile.mkdtemp(prefix="trendspark-job-", dir="/tmp")
    counts = job.land_records(spark, SF, out)
    for name, rules in job.record_sets(spark, SF).items():
        want = V.counts(rules).first()
        assert counts[name] == (want.n_valid, want.n_total)
        assert spark.read.parquet(f"{out}/records/{name}").count() == want.n_valid
        plan = V.observed_valid(rules, name)[0]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("CollectMetrics") == 1
    some = job.land_records(spark, SF, out, *job.check_dates("2000-01-01", "2000-06-30"))
    assert 0 < some["funding"][1] < counts["funding"][1]
    with pytest.raises(ValueError):
        run_job(spark, SF, out, dates=("2000-06-30", "2000-01-01"))
    with pytest.raises(ValueError):
        run_job(spark, SF, out, dates=("yesterday", "2000-01-01"))


def test_a_table_without_rows_is_not_written(spark):
    out = tempfile.mkdtemp(prefix="trendspark-sink-", dir="/tmp")
    rows = spark.range(3)
    assert write_if_any(rows, f"{out}/t") and spark.read.parquet(f"{out}/t").count() == 3
    assert not write_if_any(rows.where("id > 5"), f"{out}/t") and spark.read.parquet(f"{out}/t").count() == 3
    assert write_if_any(rows.where("id > 1"), f"{out}/t") and spark.read.parquet(f"{out}/t").count() == 1
    assert os.listdir(out) == ["t"]


def test_job_trains_and_finds_its_models_again(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    out = tempfile.mkdtemp(prefix="trendspark-job-", dir="/tmp")
    small = TrainParams(rf_grid=({"numTrees": 2, "maxDepth": 2},), gbt_grid=({"maxIter": 2, "maxDepth": 1},), n_folds=2)
    first, fits = job.tree_predictions(spark, SF, out, small, dt.datetime(2001, 8, 2))
    assert {r[5] for r in fits} == {"OK"} and first.count() == len(fits) == 10
    again, _ = job.tree_predictions(spark, SF, out, small, dt.datetime(2001, 8, 2))
    assert ModelStore(spark, f"{out}/models").registry().count() == 10
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, first.collect()), key=str)
