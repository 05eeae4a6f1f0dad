"""trendspark: technology-trend features, forecasts and monitoring as Spark jobs."""

__version__ = "0.1.0"
