"""Ensemble, intervals, emergence, opportunities, uncertainty and monitoring."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendspark.operators import emergence as em
from trendspark.operators import forecast as fc
from trendspark.operators import monitor as mo
from trendspark.operators import opportunities as iv
from trendspark.operators import uncertainty as un
from trendspark.params import EmergenceParams


def _preds(spark, rows):
    return spark.createDataFrame(rows, "sector_label string, model string, prediction double")


def test_ensemble_weights_missing_and_fallback(spark):
    p = _preds(spark, [("a", "random_forest", 0.1), ("a", "gradient_boosting", 0.2),
                       ("b", "random_forest", None), ("b", "gradient_boosting", 0.3),
                       ("c", "m1", 0.2), ("c", "m2", 0.4), ("d", "random_forest", None)])
    got = {r.sector_label: r.prediction for r in fc.ensemble(p, ["sector_label"],
                                                             {"random_forest": 0.6, "gradient_boosting": 0.4}).collect()}
    assert got["a"] == pytest.approx(0.14) and got["b"] == pytest.approx(0.3)
    assert got["c"] == pytest.approx(0.3) and got["d"] is None


def test_intervals(spark):
    p = _preds(spark, [("a", "m1", 0.06), ("a", "m2", 0.06), ("b", "m1", 0.1)])
    got = {r.sector_label: r for r in fc.intervals(p, ["sector_label"]).collect()}
    assert got["a"].ci95_low == pytest.approx(0.06) and got["a"].ci68_high == pytest.approx(0.06)
    assert got["b"].ci95_low is None


def test_emerging_threshold_uses_max_when_few_positive(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", -1.0)], "sector_label string, emergence_score double")
    got = [r.sector_label for r in em.emerging(df, "sector_label", 90.0).collect()]
    assert got == ["b"]
    # two positive scores suffice at p=50: threshold = their median 0.7
    got50 = sorted(r.sector_label for r in em.emerging(df, "sector_label", 50.0).collect())
    assert got50 == ["b"]
    none = spark.createDataFrame([("a", -0.5)], "sector_label string, emergence_score double")
    assert em.emerging(none, "sector_label", 50.0).count() == 0


def test_signals_fallback_and_risks(spark):
    df = spark.createDataFrame([("a", 0.8, 0.01, 5.0, 2.0)],
                               "sector_label string, emergence_score double, funding_deals_velocity_3m_funding double, "
                               "publication_rate_3m_research double, filing_rate_3m_patent double")
    r = em.signals(df, EmergenceParams()).first()
    assert r.key_indicators == ["Overall positive momentum (Score: 0.80)"]
    assert r.timeline_estimate == "0-1 year" and r.confidence_level == "High"
    # each family mean × 0.25: funding 0.0025 → 0.01 not below; research 1.25; patent 0.5 → none below
    assert r.risk_factors == []


def test_signals_top_contributors(spark):
    df = spark.createDataFrame([("a", 0.3, 2.0, 1.0, 0.0)],
                               "sector_label string, emergence_score double, x_patent double, y_funding double, z_research double")
    r = em.signals(df, EmergenceParams(), {"x_patent": 0.5, "y_funding": 2.0, "z_research": 1.0}).first()
    assert r.key_indicators == ["Y Funding (Value: 1.00, Contribution: 2.00)", "X Patent (Value: 2.00, Contribution: 1.00)"]
    assert r.confidence_level == "Low"
    # research family mean is 0 (0 < 0 is false); patent family mean 2 → 0.5
    assert r.risk_factors == ["Funding/Commercialization Lag", "Slowing IP Generation"]


def test_attractiveness_texts(spark):
    df = spark.createDataFrame([("s", 0.12, 0.75, 6e8), ("t", -0.02, 0.3, 0.0)],
                               "sector string, expected_growth double, quality_score double, market_size_usd double")
    got = {r.sector: r for r in iv.attractiveness(df).collect()}
    s = got["s"]
    assert s.attractiveness_score == pytest.approx(0.12 * 0.4 + 0.75 * 0.3 + 0.6 * 0.2 + 0.1)
    assert s.key_drivers == ["Strong Growth Potential (12.00%)", "Large Market Size ($600M)"]
    assert s.risk_assessment == ["Standard market and execution risks apply."]
    assert s.recommended_action == "Monitor Closely"
    t = got["t"]
    assert t.risk_assessment == ["Very Low Prediction Confidence", "Market Size Unknown/Unverified",
                                 "Low or Negative Growth Forecast (-2.00%)"]
    assert t.recommended_action == "Monitor"


def test_final_output_clamps_and_labels(spark):
    df = spark.createDataFrame([("a", 0.9, 0.3, 0.01, 0.02, None, None), ("b", 0.1, -0.5, None, None, 0.1, 0.2)],
                               "k string, base double, adj double, ci95_low double, ci95_high double, "
                               "ci68_low double, ci68_high double")
    got = {r.k: r for r in un.final_output(df, "base", "adj").collect()}
    assert got["a"].final_confidence_score == 1.0 and got["a"].confidence_label == "High"
    assert got["a"].confidence_interval_str == "[0.010, 0.020] (95% CI)"
    assert got["b"].final_confidence_score == 0.0 and got["b"].confidence_label == "Low"
    assert got["b"].confidence_interval_str == "[0.100, 0.200] (68% CI)"


def test_completeness_and_conflict(spark):
    df = spark.createDataFrame([("USPTO", "AI", 0.75), ("EPO", "AI", 0.3)], "src string, sec string, m double")
    got = {r.src: r for r in un.completeness_impact(df, "m", "src", "sec").collect()}
    assert got["USPTO"].confidence_adjustment == -0.10
    assert got["USPTO"].message == "Caution (AI): USPTO data incomplete (75%). Confidence reduced."
    assert got["EPO"].confidence_adjustment == -0.20
    sig = spark.createDataFrame([("AI", {"pat": 0.7, "fund": -0.6})], "s string, m map<string,double>")
    r = un.conflicting_signals(sig, "m", "s").first()
    assert r.status == "conflicting" and r.confidence_adjustment == -0.15
    assert "Pos: {'pat'}, Neg: {'fund'}" in r.message


def test_pipeline_health_missing_and_delay(spark):
    log = spark.createDataFrame([
        ("patents_pipeline", dt.datetime(2024, 1, 30), "SUCCESS", ""),
        ("funding_pipeline", dt.datetime(2024, 1, 1), "SUCCESS", ""),
        ("funding_pipeline", dt.datetime(2024, 1, 20), "SUCCESS", "")], mo.STATUS_SCHEMA)
    look = mo.status_lookup(mo.latest_status(log), mo.expected_pipelines(spark))
    got = {r.pipeline_name: r for r in mo.pipeline_health(look, dt.datetime(2024, 1, 31)).collect()}
    assert got["patents_pipeline"].healthy
    assert got["funding_pipeline"].delayed          # 11 days > 8
    assert got["research_pipeline"].status == "NOT_FOUND" and got["research_pipeline"].delayed
    assert not got["patents_pipeline"].all_healthy


def test_drift_zero_baseline_is_infinite(spark):
    cur = spark.createDataFrame([("a", 1.0)], "sector_label string, filing_rate_3m_patent double")
    base = spark.createDataFrame([("filing_rate_3m_patent", 0.0, 0.0)], "feature string, mean double, std double")
    r = mo.drift_check(cur, ["sector_label"], base).first()
    assert r.change == float("inf") and r.status == "DRIFT" and r.drift_detected


def test_gate_counts_a_sector_without_a_model_as_degraded(spark):
    metrics = spark.createDataFrame([("a", "m", 0.1, 0.9), ("b", "m", 0.9, 0.9), (None, "m", 0.1, 0.9)],
                                    "sector_label string, model string, mae double, direction_accuracy double")
    groups = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("c",)], "sector_label string")
    got = {r.sector_label: (r.degraded, r.n_models) for r in mo.performance_gate(metrics, ["sector_label"], groups=groups).collect()}
    assert got == {"a": (False, 1), "b": (True, 1), "c": (True, 0), None: (False, 1)}
