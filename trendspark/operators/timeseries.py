"""Time-series shaping on the sector × month panel (WN-*, JN-*, AG-20..22, EX-1..3).

Raw records are first reduced to one row per (sector, month) with a partial
aggregate; every window below runs on that panel, whose size is
sectors × months — bounded by the calendar, not by the data volume — so a
sector holding a third of all records adds no skew to any window.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.operators.common import join_keys, ts_lit

TS = "ts"


# ----------------------------------------------------------------------------
# Calendar helpers
# ----------------------------------------------------------------------------


def month_floor(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc("month", c).cast("timestamp_ntz")


def month_ceil(c: Column | str) -> Column:
    """First month start at or after ``c``."""
    c = F.col(c) if isinstance(c, str) else c
    fl = month_floor(c)
    return F.when(fl == c.cast("timestamp_ntz"), fl).otherwise(fl + F.make_ym_interval(F.lit(0), F.lit(1)))


def month_index(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c) - 1


def month_spine(spark, start: Column | dt.datetime | str, end: Column | dt.datetime | str,
                bounds: DataFrame | None = None) -> DataFrame:
    """WN-12: month starts inside [start, end] as column ``ts``.
    ``start``/``end`` are literals, or column names of the one-row ``bounds``."""
    s = ts_lit(start) if isinstance(start, (dt.datetime,)) else (F.col(start) if isinstance(start, str) else start)
    e = ts_lit(end) if isinstance(end, (dt.datetime,)) else (F.col(end) if isinstance(end, str) else end)
    base = bounds if bounds is not None else spark.range(1)
    seq = F.sequence(month_ceil(s), e.cast("timestamp_ntz"), F.make_ym_interval(F.lit(0), F.lit(1)))
    return base.select(F.explode(F.when(month_ceil(s) <= e, seq).otherwise(F.array().cast("array<timestamp_ntz>"))).alias(TS))


def dense_grid(keys_df: DataFrame, spine: DataFrame) -> DataFrame:
    """Every group × every month (both sides small: groups × calendar)."""
    return keys_df.crossJoin(spine)


# ----------------------------------------------------------------------------
# Monthly panels with trailing windows (EX-1)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Trailing:
    """``name = sum(num) / (den or months)`` over the ``months`` months before ``ts``."""
    name: str
    num: str
    months: int
    den: str | None = None


def monthly(df: DataFrame, keys: list[str], date_col: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (keys, month) with the given aggregate measures."""
    return df.groupBy(*keys, month_floor(date_col).alias(TS)).agg(
        *[m.alias(n) for n, m in measures.items()])


def trailing_panel(monthly_df: DataFrame, keys: list[str], spine: DataFrame, features: list[Trailing]) -> DataFrame:
    """EX-1: dense (keys × spine) panel; each feature looks at the months
    strictly before ``ts`` (no leakage). Empty history → 0 for rates,
    null for ratios."""
    groups = monthly_df.select(*keys).distinct()
    measures = [c for c in monthly_df.columns if c not in keys and c != TS]
    grid = join_keys(dense_grid(groups, spine), monthly_df, keys + [TS], "left").fillna(0, subset=measures)
    grid = grid.withColumn("_mi", month_index(TS))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    out = [F.col(k) for k in keys] + [F.col(TS)]
    for f in features:
        frame = w.orderBy("_mi").rangeBetween(-f.months, -1)
        num = F.coalesce(F.sum(f.num).over(frame), F.lit(0))
        if f.den is None:
            out.append((num / F.lit(float(f.months))).alias(f.name))
        else:
            den = F.sum(f.den).over(frame)
            out.append(F.try_divide(num.cast("double"), den).alias(f.name))
    return grid.select(*out)


def suffixed(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """PRJ-3: add a suffix to every non-key column."""
    return df.select(*[F.col(c) if c in keys + [TS] else F.col(c).alias(c + suffix) for c in df.columns])


def growth_target(monthly_counts: DataFrame, keys: list[str], spine: DataFrame, count_col: str = "n",
                  horizon: int = 6, name: str = "target_growth_6m") -> DataFrame:
    """EX-2: ``lead(n, h) / n − 1`` on the dense monthly grid; rows without a
    full lead or with n = 0 are dropped."""
    groups = monthly_counts.select(*keys).distinct()
    grid = join_keys(dense_grid(groups, spine), monthly_counts.select(*keys, TS, count_col), keys + [TS], "left")
    grid = grid.fillna(0, subset=[count_col])
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(TS)
    tgt = F.try_divide(F.lead(count_col, horizon).over(w).cast("double"), F.col(count_col).cast("double")) - 1.0
    return grid.select(*keys, TS, tgt.alias(name)).where(F.col(name).isNotNull())


# ----------------------------------------------------------------------------
# Alignment, fills, lags, scaling, imputation
# ----------------------------------------------------------------------------


def outer_align(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """JN-1: full outer join of feature panels on (keys, ts); a null key
    matches a null key."""
    on = keys + [TS]
    out = frames[0]
    for f in frames[1:]:
        r = f.select(*[F.col(k).alias(f"__r_{k}") for k in on], *[c for c in f.columns if c not in on])
        match = [out[k].eqNullSafe(r[f"__r_{k}"]) for k in on]
        both = out.join(r, match, "full")
        out = both.select(*[F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) for k in on],
                          *[c for c in both.columns if c not in on and not c.startswith("__r_")])
    return out


def ffill_bfill(df: DataFrame, keys: list[str], cols: list[str], order: str = TS) -> DataFrame:
    """WN-2: forward fill, then backward fill, per group in time order."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(fwd))
              for c in cols}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def lagged(df: DataFrame, keys: list[str], cols: list[str], lags: tuple[int, ...] = (1, 3, 6, 12),
           order: str = TS) -> DataFrame:
    """WN-1: row shifts per group, named ``{c}_lag{k}``."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in lags])


def _stats_join(df: DataFrame, keys: list[str], stats: DataFrame) -> DataFrame:
    return join_keys(df, stats, keys, "left")


def zscore(df: DataFrame, keys: list[str], cols: list[str], fit_on: Column | None = None) -> DataFrame:
    """WN-3: (x − mean) / population std per group; zero spread → 0.
    EX-3: with ``fit_on`` the statistics come only from the rows it selects
    (e.g. the training split) and are applied to every row."""
    fit = df if fit_on is None else df.where(fit_on)
    stats = fit.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                  *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = _stats_join(df, keys, stats)
    out = {c: ((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)))
           for c in cols}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def minmax(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """WN-4: (x − min) / (max − min) per group; constant → 0."""
    stats = df.groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols],
                                  *[F.max(c).alias(f"_hi_{c}") for c in cols])
    j = _stats_join(df, keys, stats)
    out = {}
    for c in cols:
        rng = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out[c] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(
            F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.nullif(rng, F.lit(0.0))), F.lit(0.0)))
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def median_impute(df: DataFrame, keys: list[str], cols: list[str], fit_on: Column | None = None) -> DataFrame:
    """WN-5: nulls replaced by the group median of the column (of the rows that
    ``fit_on`` selects, if given). Groups here are panel rows (months per
    sector), so the exact median aggregate is bounded."""
    fit = df if fit_on is None else df.where(fit_on)
    stats = fit.groupBy(*keys).agg(*[F.median(c).alias(f"_med_{c}") for c in cols])
    j = _stats_join(df, keys, stats)
    return j.select(*[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def drop_incomplete(df: DataFrame, cols: list[str] | None = None, how: str = "any") -> DataFrame:
    """WN-7: drop rows with any / all nulls in ``cols`` (all columns by default).

    Written as one null-count predicate rather than ``dropna`` (one IsNotNull
    per column): on wide panels the per-column constraints multiply through
    the optimizer's constraint propagation; a single sum does not."""
    cols = list(cols or df.columns)
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    keep = (nulls == 0) if how == "any" else (nulls < len(cols))
    return df.where(keep)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """PRJ-5: numeric columns by schema."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


# ----------------------------------------------------------------------------
# Splits
# ----------------------------------------------------------------------------


def chrono_split(df: DataFrame, keys: list[str], frac: float = 0.7, order: tuple[str, ...] = (TS,)) -> DataFrame:
    """WN-10: first ``max(1, int(frac·n))`` rows per group (time order) are
    'train', the rest 'test'."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy())
    rn = F.row_number().over(w.orderBy(*order))
    n = F.count(F.lit(1)).over(w)
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(frac)))
    return df.withColumn("split", F.when(rn <= cut, "train").otherwise("test"))


def expanding_folds(df: DataFrame, keys: list[str], n_splits: int = 3, order: tuple[str, ...] = (TS,)) -> DataFrame:
    """WN-11: expanding-window folds. With t = n div (splits + 1), fold f
    (0-based) trains on the first n − (splits − f)·t rows and tests on the
    next t. Output adds ``fold`` and ``role``; rows outside a fold are absent."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy())
    base = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    t = F.floor(F.col("_n") / F.lit(n_splits + 1))
    folds = base.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(n_splits)])))
    test_start = F.col("_n") - (F.lit(n_splits) - F.col("fold")) * t
    role = (F.when(F.col("_rn") <= test_start, "train")
            .when(F.col("_rn") <= test_start + t, "test"))
    return folds.withColumn("role", role).where(F.col("role").isNotNull() & (t > 0)).drop("_rn", "_n")


# ----------------------------------------------------------------------------
# As-of alignment (JN-3) without a range join
# ----------------------------------------------------------------------------


def asof_monthly(events: DataFrame, keys: list[str], date_col: str, value_cols: list[str],
                 spine: DataFrame, tie: list[str] | None = None, backfill: bool = True) -> DataFrame:
    """Value of the latest event at or before each month start, per group.

    Stage 1 reduces events to the month start they precede (``month_ceil``)
    with ``max_by`` — a partial aggregate, skew-safe. Stage 2 carries the
    last value forward across the bounded (group × month) grid; leading gaps
    are back-filled when ``backfill``."""
    order = F.struct(F.col(date_col), *[F.col(c) for c in (tie or [])])
    last = events.groupBy(*keys, month_ceil(date_col).alias(TS)).agg(
        *[F.max_by(F.col(v), order).alias(v) for v in value_cols])
    groups = events.select(*keys).distinct()
    grid = join_keys(dense_grid(groups, spine), last, keys + [TS], "left")
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(TS)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cols = []
    for v in value_cols:
        c = F.last(v, ignorenulls=True).over(back)
        if backfill:
            c = F.coalesce(c, F.first(v, ignorenulls=True).over(fwd))
        cols.append(c.alias(v))
    return grid.select(*keys, TS, *cols)


def latest_non_null(df: DataFrame, keys: list[str], cols: list[str], order: str = TS) -> DataFrame:
    """AG-20: last non-null value of each column per group (``groupby.last``)."""
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
                                   for c in cols])


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """TK-8: the first row of each group by ``order`` (an aggregate, no window)."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
