"""Record validation with reject reasons (FLT-1 .. FLT-6, FLT-15).

Each rule set yields a ``reject_reason`` column (null = valid); valid rows
and rejects come from the same lazy plan, and counts are one aggregate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _truthy(c: str) -> Column:
    col = F.col(c)
    return col.isNotNull() & (col.cast("string") != "")


def _missing(fields: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~_truthy(f), F.lit(f)) for f in fields]))


def _reason(missing: Column, date_ok: Column, date_col: str) -> Column:
    return (F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
            .when(~date_ok, F.concat(F.lit("bad date: "), F.coalesce(F.col(date_col).cast("string"), F.lit("null")))))


def patent_rules(df: DataFrame, date_col: str = "filing_date", pattern: str = "yyyy-M-d",
                 fields: tuple[str, ...] = ("patent_id", "filing_date", "title")) -> DataFrame:
    """FLT-1 (pattern yyyy-M-d, like strptime's %Y-%m-%d) and FLT-4
    (pattern yyyyMMdd, title 'N/A' passes)."""
    missing = _missing(list(fields))
    date_ok = F.try_to_date(F.col(date_col).cast("string"), pattern).isNotNull()
    return df.withColumn("reject_reason", _reason(missing, date_ok, date_col))


def paper_rules(df: DataFrame) -> DataFrame:
    """FLT-3: id, title and abstract present and not 'N/A', date present,
    at least one author."""
    checks = {
        "paper_id": _truthy("paper_id"),
        "title": _truthy("title") & (F.col("title") != "N/A"),
        "abstract": _truthy("abstract") & (F.col("abstract") != "N/A"),
        "published_date": F.col("published_date").isNotNull(),
        "authors": F.col("authors").isNotNull() & (F.size("authors") > 0),
    }
    missing = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("reject_reason", F.when(F.size(missing) > 0,
                                                 F.concat(F.lit("missing: "), F.array_join(missing, ", "))))


def funding_rules(df: DataFrame) -> DataFrame:
    """FLT-2 (the flattener already computed ``is_valid``)."""
    return df.withColumn("reject_reason", F.when(~F.col("is_valid"), F.lit("missing: value_usd/announced_on/organization")))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """FLT-6: validated n of m (one aggregate)."""
    return df.groupBy(*(keys or [])).agg(F.count_if(F.col("reject_reason").isNull()).alias("n_valid"),
                                         F.count(F.lit(1)).alias("n_total"))


def observed_valid(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """FLT-6 with the write: the valid rows, and an observation that has
    n_valid and n_total once the action that uses them has run; the records are
    scanned once."""
    seen = Observation(f"validated {name}")
    ok = F.col("reject_reason").isNull()
    return valid(df.observe(seen, F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n_total"))), seen


def rule_pass_ratios(df: DataFrame, rules: dict[str, Column], threshold: float) -> DataFrame:
    """FLT-15: pass count and ratio per declared rule against a quality bar."""
    stats = df.agg(F.count(F.lit(1)).alias("n_total"),
                   *[F.count_if(F.coalesce(r, F.lit(False))).alias(f"_p{i}") for i, r in enumerate(rules.values())])
    long = stats.select("n_total", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"_p{i}").alias("n_pass")) for i, name in enumerate(rules)]))
        .alias("_r")).select("_r.rule", "_r.n_pass", "n_total")
    ratio = F.try_divide(F.col("n_pass").cast("double"), F.col("n_total").cast("double"))
    return long.select("rule", "n_pass", "n_total", ratio.alias("pass_ratio"),
                       F.coalesce(ratio >= threshold, F.lit(False)).alias("meets_threshold"))
