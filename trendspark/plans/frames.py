"""Alignment and training data from the caller's own frames (PRJ-7, WN-13, WN-14).

A frame has a time column (``ts``, or else the first of the known date columns
it has), optional group keys and feature columns. A frame that is missing, has
no rows, no date column or dates that cannot be read counts as empty; what is
then left is aligned without it. Everything but these emptiness checks is one
lazy plan.
"""
from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators import timeseries as ts
from trendspark.operators.common import join_keys

log = logging.getLogger(__name__)
TS = ts.TS

# FIXED VALUES: date columns by preference, the suffixes of the feature frames, the target's name.
DATE_COLUMNS = ("date", "filing_date", "published_date", "timestamp")
SUFFIXES = ("_patent", "_funding", "_research")
TARGET = "target_growth_6m"


def with_time(df: DataFrame | None, name: str) -> DataFrame | None:
    """The frame with its time in ``ts`` (its date column is dropped); None for
    an empty one. Text dates are read as ISO; one that cannot be read makes the
    frame empty, as a wrong column would. Rows without a date are kept out."""
    if df is None:
        return None
    if TS not in df.columns:
        column = next((c for c in DATE_COLUMNS if c in df.columns), None)
        if column is None:
            log.warning("%s has no date column and is left out", name)
            return None
        at = F.col(f"`{column}`")
        if isinstance(df.schema[column].dataType, T.StringType):
            parsed = at.try_cast("timestamp_ntz")
            if not df.where(at.isNotNull() & parsed.isNull()).isEmpty():
                log.warning("%s has dates in %s that cannot be read and is left out", name, column)
                return None
            at = parsed
        df = df.withColumn(TS, at.cast("timestamp_ntz")).drop(column)
    df = df.where(F.col(TS).isNotNull())
    return None if df.isEmpty() else df


def target_column(targets: DataFrame, keys: list[str]) -> str | None:
    """The target's usual name, or else the frame's first column besides keys and time."""
    values = [c for c in targets.columns if c not in keys + [TS]]
    return TARGET if TARGET in values else values[0] if values else None


def align(patents: DataFrame | None, funding: DataFrame | None, research: DataFrame | None, targets: DataFrame | None,
          keys: list[str]) -> DataFrame | None:
    """WN-13: feature frames with suffixes, full outer join on keys and time,
    inner join with the target, then forward and backward fill per group.

    Without features the target alone is returned; without targets the
    features; without either None. Null keys are a group; equal times in a
    frame are joined one with each other, as rows of a merge are."""
    frames = [with_time(f, n) for f, n in ((patents, "patents"), (funding, "funding"), (research, "research"))]
    frames = [ts.suffixed(f, keys, s) for f, s in zip(frames, SUFFIXES) if f is not None]
    targets = with_time(targets, "targets")
    name = target_column(targets, keys) if targets is not None else None
    y = targets.select(*keys, TS, name) if name else None
    if not frames:
        return y
    merged = ts.outer_align(frames, keys)
    merged = merged.select(*keys, TS, *[c for c in merged.columns if c not in keys + [TS]])
    if y is not None:
        merged = join_keys(merged, y, keys + [TS], "inner")
    return ts.ffill_bfill(merged, keys, [c for c in merged.columns if c not in keys + [TS]])


@dataclass
class TrainingData:
    """``rows``: keys, time, features and target (None: nothing to train on).
    ``counts`` has n_rows and n_dropped once an action has run on ``rows``."""
    rows: DataFrame | None = None
    features: list[str] = field(default_factory=list)
    counts: Observation | None = None


def prepare_training(patents: DataFrame | None, funding: DataFrame | None, research: DataFrame | None, targets: DataFrame | None,
                     keys: list[str], lags: tuple[int, ...] = (1, 3, 6, 12), fit_fraction: float | None = None) -> TrainingData:
    """WN-14: align, z-score, lags, medians for what is still null, and without
    the rows that stay incomplete; their number is observed by the job that
    uses the rows, without a scan of its own. ``fit_fraction``: means, spreads
    and medians come from the first rows of each group alone (the training
    rows of ``timeseries.chrono_split``); by default from all.

    Needs a target of the usual name and a feature; else there are no rows."""
    aligned = align(patents, funding, research, targets, keys)
    if aligned is None or TARGET not in aligned.columns:
        log.warning("no target after alignment: nothing to train on")
        return TrainingData()
    features = [c for c in aligned.columns if c not in keys + [TS, TARGET]]
    if not features:
        log.warning("no feature after alignment: nothing to train on")
        return TrainingData()
    fit_on = None
    if fit_fraction is not None:
        aligned = ts.chrono_split(aligned, keys, fit_fraction)
        fit_on = F.col("split") == "train"
    scaled = ts.zscore(aligned, keys, features, fit_on)
    lagged = ts.lagged(scaled, keys, features, lags)
    every = [*features, *[f"{c}_lag{k}" for c in features for k in lags]]
    filled = ts.median_impute(lagged, keys, every, fit_on)
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in every), F.lit(0)) > 0
    counts = Observation("training rows")
    seen = filled.observe(counts, F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_dropped"))
    return TrainingData(seen.where(~missing).select(*keys, TS, *every, TARGET), every, counts)
