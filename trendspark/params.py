"""Parameters of the trend jobs.

Everything is a frozen dataclass passed explicitly to the operators; nothing
reads a clock or the environment. The values below are FIXED VALUES that must
equal the behaviour being reproduced (weights, thresholds, labels, texts and
word lists); they are stated plainly and in their natural order.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop words (the common 179-word English list).
# ---------------------------------------------------------------------------
STOP_WORDS: tuple[str, ...] = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven",
    "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't",
    "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't",
    "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: configured emerging-technology keywords (in configured order).
# ---------------------------------------------------------------------------
EMERGING_TECH_KEYWORDS: tuple[str, ...] = (
    "artificial intelligence", "machine learning", "deep learning",
    "quantum computing", "quantum supremacy",
    "blockchain", "cryptocurrency", "smart contract", "nft",
    "biotechnology", "gene editing", "crispr", "synthetic biology",
    "renewable energy", "solar power", "wind power", "battery storage", " sostenible", " जलवायु",
    "nanotechnology", "carbon nanotubes",
)

# FIXED VALUES: source names that count as domestic for the international ratio.
DOMESTIC_SOURCES: tuple[str, ...] = ("USPTO", "US")

# FIXED VALUES: stage labels (first lower-case key, then its title-case fallback).
SEED_STAGES: tuple[str, str] = ("seed", "Seed")
SERIES_A_STAGES: tuple[str, str] = ("series_a", "Series A")
LATE_STAGES: tuple[str, ...] = (
    "series_c", "series_d", "series_e", "late_stage_venture", "Series C", "Series D", "Series E",
)

# FIXED VALUES: date columns tried in order when a frame has no explicit time column.
DATE_COLUMN_CANDIDATES: tuple[str, ...] = ("date", "filing_date", "published_date", "timestamp")


@dataclass(frozen=True)
class FeatureParams:
    """Windows (months) of the rate features and the keyword list."""
    patent_rate_months: tuple[int, ...] = (3, 6, 12)
    funding_rate_months: tuple[int, ...] = (3, 6)
    research_rate_months: tuple[int, ...] = (3, 6)
    keywords: tuple[str, ...] = EMERGING_TECH_KEYWORDS
    stop_words: tuple[str, ...] = STOP_WORDS
    # FIXED VALUES: Shannon epsilon and average month length in days.
    shannon_epsilon: float = 1e-10
    days_per_month: float = 30.44
    exact_quantiles: bool = True  # False → approx_percentile (median), approx_count_distinct (inventors)


@dataclass(frozen=True)
class IndexWeights:
    """Weights of the innovation indices (ML-6), keyed by real feature names."""
    # FIXED VALUES: family weights of the three indices.
    innovation: tuple[float, float, float] = (0.40, 0.35, 0.25)        # patent, funding, research
    commercial_readiness: tuple[float, float] = (0.60, 0.40)          # funding, patent
    research_momentum: tuple[float, float] = (0.70, 0.30)             # research, patent
    patent: dict = field(default_factory=lambda: {
        "filing_rate_3m": 0.25, "citation_velocity_avg": 0.20, "tech_diversity_shannon": 0.15,
        "international_filing_ratio": 0.15, "unique_inventor_count": 0.25})
    funding: dict = field(default_factory=lambda: {
        "funding_deals_velocity_3m": 0.30, "avg_round_size_usd": 0.25,
        "seed_ratio": 0.20, "funding_amount_gini": 0.25})
    research: dict = field(default_factory=lambda: {
        "publication_rate_3m": 0.25, "avg_citation_count": 0.25,
        "avg_authors_per_paper": 0.20, "category_diversity_shannon": 0.30})


@dataclass(frozen=True)
class EmergenceParams:
    # FIXED VALUES: indicator weights; only the first three map to features.
    indicator_weights: dict = field(default_factory=lambda: {
        "patent_filing_acceleration": 0.3, "funding_velocity_increase": 0.25,
        "research_publication_growth": 0.25, "cross_disciplinary_collaboration": 0.1,
        "keyword_novelty_score": 0.1})
    # FIXED VALUES: which feature each scored indicator reads.
    indicator_features: dict = field(default_factory=lambda: {
        "patent_filing_acceleration": "filing_rate_3m_patent",
        "funding_velocity_increase": "funding_deals_velocity_3m_funding",
        "research_publication_growth": "publication_rate_3m_research"})
    threshold_percentile: float = 90.0
    # FIXED VALUES: timeline and confidence bands.
    timeline_fast: float = 0.70
    timeline_medium: float = 0.40
    confidence_high: float = 0.70
    confidence_medium: float = 0.40
    # FIXED VALUES: risk texts.
    risk_low_funding: str = "Funding/Commercialization Lag"
    risk_low_research: str = "Weakening Research Base"
    risk_low_patent: str = "Slowing IP Generation"
    risk_nascent: str = "Market Adoption Uncertainty"
    family_default_threshold: float = 0.1
    family_factor: float = 0.25


@dataclass(frozen=True)
class InvestmentParams:
    # FIXED VALUES: ranking weights and thresholds.
    growth_potential: float = 0.4
    confidence_score: float = 0.3
    market_size: float = 0.2
    risk_adjusted_return: float = 0.1
    high_growth_threshold: float = 0.10
    low_growth_threshold: float = 0.01
    large_market_threshold_usd: float = 500000000.0
    min_market_size_threshold_usd: float = 100000000.0
    action_invest_score_thresh: float = 0.5
    action_invest_growth_thresh: float = 0.05
    action_monitor_score_thresh: float = 0.3
    confidence_high: float = 0.8
    confidence_medium: float = 0.6
    confidence_low: float = 0.4
    quality_score: float = 0.75
    preferred_horizon: int = 12


@dataclass(frozen=True)
class ForecastParams:
    horizons: tuple[int, ...] = (6, 12, 18)
    # FIXED VALUES: model weights of the ensemble.
    weights: dict = field(default_factory=lambda: {"random_forest": 0.6, "gradient_boosting": 0.4})
    quality_score: float = 0.75
    # FIXED VALUES: interval levels → percentiles (68% → 16/84, 95% → 2.5/97.5).
    levels: tuple[float, ...] = (0.68, 0.95)


@dataclass(frozen=True)
class MonitorParams:
    # FIXED VALUES: pipelines checked for health and their allowed delay in days.
    pipelines: dict = field(default_factory=lambda: {
        "patents_pipeline": 2, "funding_pipeline": 8, "research_pipeline": 2})
    # FIXED VALUES: drift thresholds per watched feature, default 0.20.
    drift_thresholds: dict = field(default_factory=lambda: {
        "filing_rate_3m_patent": 0.20, "funding_amount_velocity_3m_usd_funding": 0.25,
        "publication_rate_3m_research": 0.15})
    default_drift_threshold: float = 0.20
    # FIXED VALUES: model acceptance limits.
    max_mae: float = 0.15
    min_direction_accuracy: float = 0.65
    auto_retraining_enabled: bool = True


@dataclass(frozen=True)
class UncertaintyParams:
    # FIXED VALUES: confidence bands and adjustment steps.
    low: float = 0.4
    medium: float = 0.6
    high: float = 0.8
    min_completeness: float = 0.80
    min_paper_coverage: float = 0.60
    completeness_severe: float = -0.20
    completeness_mild: float = -0.10
    coverage_severe: float = -0.15
    coverage_mild: float = -0.05
    conflict_adjustment: float = -0.15
    conflict_high: float = 0.5
    conflict_low: float = -0.5


# FIXED VALUES: the searched grids. min_samples_split (2, 5) has no MLlib parameter, so the
# 16 points of the forests are 8; the grids' sizes and depths replace the blueprints' own.
RF_GRID = tuple({"numTrees": n, "maxDepth": d, "minInstancesPerNode": leaf}
                for n in (50, 100) for d in (5, 10) for leaf in (1, 2))
GBT_GRID = tuple({"maxIter": n, "stepSize": lr, "maxDepth": d, "subsamplingRate": ss}
                 for n in (50, 100) for lr in (0.05, 0.1) for d in (3, 5) for ss in (0.8, 1.0))


@dataclass(frozen=True)
class TrainParams:
    """Tree ensembles per sector. The default is the full grids."""
    min_samples: int = 20
    n_folds: int = 3
    rf_grid: tuple[dict, ...] = RF_GRID
    gbt_grid: tuple[dict, ...] = GBT_GRID
    seed: int = 42
    parallelism: int = 8


# FIXED VALUES: the whole grids, 16 points a model.
FOREST_POINTS = tuple({"n_estimators": n, "max_depth": d, "min_samples_split": split, "min_samples_leaf": leaf}
                      for n in (50, 100) for d in (5, 10) for split in (2, 5) for leaf in (1, 2))
BOOSTING_POINTS = tuple({"n_estimators": n, "learning_rate": rate, "max_depth": d, "subsample": share}
                        for n in (50, 100) for rate in (0.05, 0.1) for d in (3, 5) for share in (0.8, 1.0))


@dataclass(frozen=True)
class GridParams:
    """Tree ensembles per sector as grouped tasks. The default is the whole grids."""
    min_samples: int = 20
    n_folds: int = 3
    forest: tuple[dict, ...] = FOREST_POINTS
    boosting: tuple[dict, ...] = BOOSTING_POINTS
    seed: int = 42


# One point per model: the headline bench's grid (not a default of the library).
SMALL_GRID = GridParams(forest=({"n_estimators": 20, "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 1},),
                        boosting=({"n_estimators": 5, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0},))
