"""End-to-end trend job: features → panel → forecasts → rankings →
monitoring → uncertainty, written as Parquet tables under ``out_dir``, with
status rows appended to a status log (SNK-1..3, SRC-2). All figures are as of
one date; health is judged on the job's own log."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark import bindings as B
from trendspark.operators import monitor as mo
from trendspark.operators import timeseries as ts
from trendspark.operators import validate as V
from trendspark.operators.features import funding_features, patent_features, research_features
from trendspark.params import ForecastParams, TrainParams
from trendspark.plans import forecasting as FC
from trendspark.plans import panel as P
from trendspark.plans import training as TR
from trendspark.plans.model_store import ModelStore
from trendspark.sources.conform import write_if_any
from trendspark.sources.scan import load_or_build

K = ["sector_label"]


def check_dates(start: str, end: str) -> tuple[dt.datetime, dt.datetime]:
    """FLT-14: both dates parse as YYYY-MM-DD and end is not before start."""
    try:
        s, e = dt.datetime.strptime(start, "%Y-%m-%d"), dt.datetime.strptime(end, "%Y-%m-%d")
    except ValueError as exc:
        raise ValueError(f"dates must be YYYY-MM-DD: {start!r}, {end!r}") from exc
    if e < s:
        raise ValueError(f"end date {end} is before start date {start}")
    return s, e


def record_sets(spark: SparkSession, sf_dir: str, start: dt.datetime | None = None,
                end: dt.datetime | None = None) -> dict[str, DataFrame]:
    """The three record sets of the days from ``start`` to ``end`` (all by
    default) with their reject reasons (FLT-1 to FLT-5)."""
    def days(df: DataFrame, column: str) -> DataFrame:
        day = F.to_date(column)
        keep = (day >= F.lit(start.date()) if start else F.lit(True)) & (day <= F.lit(end.date()) if end else F.lit(True))
        return df.where(keep) if start or end else df
    patents, funding, papers = (days(b(spark, sf_dir), c) for b, c in ((B.patents, "filing_date"), (B.funding, "date"), (B.papers, "published_date")))
    amount = F.col("amount_usd")
    whole = amount.isNotNull() & ~F.isnan(amount) & (amount != 0) & F.col("date").isNotNull() & (F.coalesce("company_uuid", F.lit("")) != "")
    return {"patents": V.patent_rules(patents.withColumn("filing_date", F.date_format("filing_date", "yyyy-MM-dd"))),
            "funding": V.funding_rules(funding.withColumn("is_valid", whole)).drop("is_valid"),
            "papers": V.paper_rules(papers)}


def land_records(spark: SparkSession, sf_dir: str, out: str, start: dt.datetime | None = None,
                 end: dt.datetime | None = None) -> dict[str, tuple[int, int]]:
    """Write the valid records of each set to ``{out}/records``; validated n of
    m per set, counted by the writes themselves (FLT-6)."""
    counts = {}
    for name, rules in record_sets(spark, sf_dir, start, end).items():
        rows, seen = V.observed_valid(rules, name)
        write_if_any(rows, f"{out.rstrip('/')}/records/{name}")
        counts[name] = (seen.get["n_valid"], seen.get["n_total"])
    return counts


def tree_predictions(spark: SparkSession, sf_dir: str, out: str, train: TrainParams, as_of: dt.datetime) -> tuple[DataFrame, list[tuple]]:
    """Predictions of the tree models for each sector's latest row, and the
    result rows of the training. Models are kept in ``{out}/models`` and found
    there by later runs on the same training rows (PRJ-6)."""
    table = P.training_table(spark, sf_dir, as_of)
    models = TR.train_sector_models(table, train, ModelStore(spark, f"{out}/models"))
    latest = ts.first_row(table.withColumn("_neg", -F.unix_micros(F.col(ts.TS).cast("timestamp"))), K, ["_neg"]).drop("_neg")
    return TR.predict(models, latest), models.rows


def run_job(spark: SparkSession, sf_dir: str, out_dir: str, as_of: dt.datetime = B.AS_OF,
            force: bool = False, dates: tuple[str, str] | None = None, train: TrainParams | None = None) -> dict[str, bool]:
    """Build every output table; cached inputs are reused unless ``force``.
    Returns which tables were written (a table with no rows is skipped).

    ``dates``: first and last day of the records to land (checked, FLT-14; all
    by default); they are the job's input check, its figures are as of
    ``as_of``. ``train``: forecast with tree models fitted by the job instead
    of the closed-form predictors."""
    start, end = check_dates(*dates) if dates else (None, None)
    out = out_dir.rstrip("/")
    status_path = f"{out}/pipeline_status"
    mo.ensure_status_log(spark, status_path)
    mo.append_status(spark, status_path, "main_run", "STARTED", f"sf_dir={sf_dir}")
    counts = land_records(spark, sf_dir, out, start, end)
    feats = {
        "patent_features": lambda: patent_features(B.patents(spark, sf_dir), keys=K, as_of=as_of),
        "funding_features": lambda: funding_features(B.funding(spark, sf_dir), keys=K, as_of=as_of),
        "research_features": lambda: research_features(B.papers(spark, sf_dir), keys=K, as_of=as_of),
    }
    for name, build in feats.items():
        load_or_build(spark, f"{out}/{name}", build, force=force)
    sp = FC.split_panel(spark, sf_dir, as_of)  # the aligned panel once, lineage cut
    for source, records, name in (("patents", "patents", "patent_features"), ("funding", "funding", "funding_features"), ("research", "papers", "research_features")):
        done = not spark.read.parquet(f"{out}/{name}").isEmpty()
        mo.append_status(spark, status_path, f"{source}_pipeline", "SUCCESS" if done else "FAILED",
                         f"{name}; validated {counts[records][0]} of {counts[records][1]}")
    preds = weights = None
    if train is not None:
        preds, fits = tree_predictions(spark, sf_dir, out, train, as_of)
        weights = ForecastParams()
        mo.append_status(spark, status_path, "training", "SUCCESS" if any(r[5] == "OK" for r in fits) else "FAILED",
                         f"{sum(r[5] == 'OK' for r in fits)} of {len(fits)} models")
    status, now = mo.read_status_log(spark, status_path), dt.datetime.now()
    tables = {
        "aligned_panel": lambda: sp,
        "sector_forecasts": lambda: FC.forecasts(spark, sf_dir, weights or FC.TREND_FORECAST, sp=sp, as_of=as_of, preds=preds),
        "emerging_technologies": lambda: FC.emerging_technologies(spark, sf_dir, sp=sp),
        "investment_opportunities": lambda: FC.opportunities(spark, sf_dir, sp=sp, as_of=as_of),
        "pipeline_health": lambda: FC.pipeline_health(spark, sf_dir, now, log=status),
        "drift_check": lambda: FC.drift_check(spark, sf_dir, sp=sp),
        "final_predictions": lambda: FC.final_predictions(spark, sf_dir, sp=sp, as_of=as_of),
        "maintenance_report": lambda: FC.maintenance_report(spark, sf_dir, now, sp=sp, log=status),
    }
    written = {name: write_if_any(build(), f"{out}/{name}") for name, build in tables.items()}
    mo.append_status(spark, status_path, "main_run", "COMPLETED", "Run finished successfully.")
    return written
