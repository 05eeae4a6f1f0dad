"""Column expressions for the per-value rules (SC-1 .. SC-19).

All are built-in Spark expressions: no Python UDF, so they stay inside
whole-stage code generation.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fallback(*cols: Column | str) -> Column:
    """SC-1: first non-null value of a chain."""
    return F.coalesce(*[col_(c) for c in cols])


def list_len_or_one(c: Column | str) -> Column:
    """SC-2: length of a list; a missing or non-list value counts as 1."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(1)).otherwise(F.size(c))


def one_line(c: Column | str) -> Column:
    """SC-3: newlines replaced by spaces."""
    return F.translate(col_(c), "\n", " ")


def name_join(*parts: Column | str) -> Column:
    """SC-4: join name parts with a space and trim."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(col_(p), F.lit("")) for p in parts]))


def date_from_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """SC-5: date from text parts; year defaults to 1900, month to 'Jan', day to 1.
    The month may be a 3-letter name, a full name or a number; failure → null."""
    y = F.coalesce(F.nullif(F.trim(col_(year)), F.lit("")), F.lit("1900"))
    m = F.coalesce(F.nullif(F.trim(col_(month)), F.lit("")), F.lit("Jan"))
    d = F.coalesce(F.nullif(F.trim(col_(day)), F.lit("")), F.lit("1"))
    text = F.concat_ws(" ", y, m, d)
    is_num = m.rlike("^[0-9]+$")
    return (F.when(is_num, F.try_to_timestamp(text, F.lit("yyyy M d")))
            .when(F.length(m) == 3, F.try_to_timestamp(text, F.lit("yyyy MMM d")))
            .otherwise(F.try_to_timestamp(text, F.lit("yyyy MMMM d")))).cast("date")


def finite(c: Column | str) -> Column:
    """SC-8: true for a finite double (not NaN, not ±inf)."""
    c = col_(c)
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clamp01(c: Column | str) -> Column:
    """SC-10: clamp to 0..1, null stays null (greatest/least skip nulls)."""
    c = col_(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def bands(c: Column | str, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """SC-11: ``c >= cut`` → label, first match wins, in the given order."""
    c = col_(c)
    expr = None
    for cut, label in cuts:
        expr = F.when(c >= F.lit(cut), label) if expr is None else expr.when(c >= F.lit(cut), label)
    return expr.otherwise(otherwise) if expr is not None else F.lit(otherwise)


def fixed(c: Column | str, decimals: int) -> Column:
    """SC-12: number text with a fixed count of decimals, half-even like
    Python's format spec, no thousands separator."""
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", col_(c), F.lit(pattern))


def percent(c: Column | str, decimals: int = 2) -> Column:
    """SC-12: ``{:.2%}``."""
    return F.concat(fixed(col_(c) * F.lit(100.0), decimals), F.lit("%"))


def title_words(c: Column | str) -> Column:
    """SC-13: ``name.replace('_', ' ').title()``."""
    return F.initcap(F.replace(col_(c), F.lit("_"), F.lit(" ")))


def iso_ts(c: Column | str) -> Column:
    """SC-14: ISO text → timestamp_ntz, bad text → null."""
    c = col_(c)
    whole = c.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d{1,6})?)?$")
    return F.when(whole, c.try_cast("timestamp_ntz"))  # no time zone on the way


def is_domestic(c: Column | str, domestic: tuple[str, ...]) -> Column:
    """SC-15: upper-case membership; null counts as not domestic."""
    return F.coalesce(F.upper(col_(c)).isin(*domestic), F.lit(False))


def ymd_compact(c: Column | str) -> Column:
    """SC-16: date text without dashes."""
    return F.replace(col_(c), F.lit("-"), F.lit(""))


def split_trim(c: Column | str, sep: str = ",") -> Column:
    """SC-16: comma list → trimmed items."""
    return F.transform(F.split(col_(c), sep), lambda t: F.trim(t))


def filter_map_by_value(m: Column | str, op: str, bound: float) -> Column:
    """SC-17: keep entries whose value is ``op`` bound ('>' or '<')."""
    if op == ">":
        return F.map_filter(col_(m), lambda k, v: v > F.lit(bound))
    return F.map_filter(col_(m), lambda k, v: v < F.lit(bound))


def row_mean(cols: list[Column | str]) -> Column:
    """SC-18: mean over the non-null values of several columns (null if none)."""
    arr = F.filter(F.array(*[col_(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0,
                  F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def relative_change(cur: Column | str, base: Column | str) -> Column:
    """SC-19: |cur − base| / |base|; zero base → inf if changed, else 0."""
    cur, base = col_(cur), col_(base)
    return (F.when(base != 0, F.abs(cur - base) / F.abs(base))
            .when(cur != 0, F.lit(float("inf")))
            .otherwise(F.lit(0.0)))
