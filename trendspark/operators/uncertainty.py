"""Confidence adjustments and final prediction labels (UN-1..5)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions.scalars import clamp01, fixed
from trendspark.params import UncertaintyParams


def _named(c: Column) -> Column:
    """A name as part of a message; null (the sector of its own) shows as nothing."""
    return F.coalesce(c.cast("string"), F.lit(""))


def completeness_impact(df: DataFrame, metric: str, source: str, sector: str,
                        p: UncertaintyParams = UncertaintyParams()) -> DataFrame:
    """UN-1: completeness below half the minimum → −0.20, below the minimum →
    −0.10, with a message (percent, no decimals)."""
    m = F.col(metric)
    pct = fixed(m * 100.0, 0)
    adj = (F.when(m < p.min_completeness / 2, F.lit(p.completeness_severe))
           .when(m < p.min_completeness, F.lit(p.completeness_mild)).otherwise(F.lit(0.0)))
    msg = (F.when(m < p.min_completeness / 2,
                  F.concat(F.lit("Warning ("), _named(F.col(sector)), F.lit("): "), _named(F.col(source)),
                           F.lit(" data very incomplete ("), pct, F.lit("%). Confidence reduced.")))
           .when(m < p.min_completeness,
                 F.concat(F.lit("Caution ("), _named(F.col(sector)), F.lit("): "), _named(F.col(source)),
                          F.lit(" data incomplete ("), pct, F.lit("%). Confidence reduced.")))
           .otherwise(F.lit("")))
    return df.select("*", adj.alias("confidence_adjustment"), msg.alias("message"))


def _set_text(keys: Column) -> Column:
    quoted = F.transform(F.array_sort(keys), lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def conflicting_signals(df: DataFrame, signals: str, sector: str,
                        p: UncertaintyParams = UncertaintyParams()) -> DataFrame:
    """UN-2: a signal above 0.5 and one below −0.5 → −0.15 and a
    'conflicting' status (names sorted for a stable message)."""
    pos = F.map_keys(F.map_filter(F.col(signals), lambda k, v: v > F.lit(p.conflict_high)))
    neg = F.map_keys(F.map_filter(F.col(signals), lambda k, v: v < F.lit(p.conflict_low)))
    conflict = (F.size(pos) > 0) & (F.size(neg) > 0)
    msg = F.when(conflict, F.concat(F.lit("Conflicting signals for '"), _named(F.col(sector)), F.lit("'. Pos: "),
                                    _set_text(pos), F.lit(", Neg: "), _set_text(neg),
                                    F.lit(". Increased uncertainty. Consider scenario analysis."))) \
        .otherwise(F.concat(F.lit("Signals for '"), _named(F.col(sector)), F.lit("' generally consistent.")))
    return df.select("*", F.when(conflict, F.lit(p.conflict_adjustment)).otherwise(F.lit(0.0)).alias("confidence_adjustment"),
                     F.when(conflict, "conflicting").otherwise("consistent").alias("status"),
                     msg.alias("message"), conflict.alias("scenarios_suggested"))


def research_gap(df: DataFrame, coverage: str, sector: str, p: UncertaintyParams = UncertaintyParams()) -> DataFrame:
    """UN-3: paper coverage below half the minimum → −0.15, below → −0.05."""
    c = F.col(coverage)
    pct = fixed(c * 100.0, 0)
    adj = (F.when(c < p.min_paper_coverage / 2, F.lit(p.coverage_severe))
           .when(c < p.min_paper_coverage, F.lit(p.coverage_mild)).otherwise(F.lit(0.0)))
    msg = (F.when(c < p.min_paper_coverage / 2,
                  F.concat(F.lit("Warning ("), _named(F.col(sector)), F.lit("): Research visibility gap - sparse papers ("),
                           pct, F.lit("%). Low research insight reliability.")))
           .when(c < p.min_paper_coverage,
                 F.concat(F.lit("Caution ("), _named(F.col(sector)), F.lit("): Moderate research visibility gap ("),
                          pct, F.lit("%). Caution with research insights.")))
           .otherwise(F.lit("")))
    return df.select("*", adj.alias("confidence_adjustment"), msg.alias("message"))


def final_output(df: DataFrame, base: str, adjustments: str, p: UncertaintyParams = UncertaintyParams(),
                 ci95: tuple[str, str] = ("ci95_low", "ci95_high"),
                 ci68: tuple[str, str] = ("ci68_low", "ci68_high")) -> DataFrame:
    """UN-4: clamp(base + Σ adjustments) → Low / Medium / High with a
    disclaimer; interval text prefers 95% then 68%, else 'N/A'."""
    score = clamp01(F.col(base) + F.coalesce(F.col(adjustments), F.lit(0.0)))
    label = F.when(score < p.low, "Low").when(score < p.medium, "Medium").otherwise("High")
    disclaimer = (F.when(score < p.low, "Low confidence. Interpret with extreme caution.")
                  .when(score < p.medium, "Medium confidence. Corroborate with other sources.")
                  .otherwise("High confidence. Subject to unforeseen events."))

    def text(lo: str, hi: str, tag: str) -> Column:
        return F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(),
                      F.concat(F.lit("["), fixed(lo, 3), F.lit(", "), fixed(hi, 3), F.lit(f"] ({tag} CI)")))

    interval = F.coalesce(text(*ci95, "95%"), text(*ci68, "68%"), F.lit("N/A"))
    return df.select("*", score.alias("final_confidence_score"), label.alias("confidence_label"),
                     interval.alias("confidence_interval_str"), disclaimer.alias("disclaimer"))


def recommendation(source: Column, sector: Column, issue: Column) -> Column:
    """UN-5: alternative-source recommendation text."""
    return F.concat(F.lit("Issue with '"), _named(source), F.lit("' for '"), _named(sector), F.lit("': "), _named(issue),
                    F.lit(". Consider: [Expert Interviews], [Market Reports], [Analogous Sector Analysis], "
                          "[Scenario Planning]."))
