"""Query plans: the registered queries and the end-to-end jobs."""
from trendspark.plans.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for mod in ("queries_features", "queries_timeseries", "queries_forecast", "queries_ingest", "queries_scalars", "queries_ml", "queries_streaming",
                "queries_incremental"):
        importlib.import_module(f"trendspark.plans.{mod}")
