"""Small shared helpers for operators."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ts_lit(value: dt.datetime | str) -> Column:
    """TIMESTAMP_NTZ literal (wall clock)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def months_before(as_of: dt.datetime | str, months: int) -> Column:
    """``as_of − months`` with calendar months (clamped at month end, time kept)."""
    return ts_lit(as_of) - F.make_ym_interval(F.lit(0), F.lit(int(months)))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` treating null keys as equal (a null sector is a group
    of its own, as in a group-by). Without keys the right side is one row."""
    if not keys:
        return left.crossJoin(right)
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(num, den)
