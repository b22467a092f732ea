"""Feature engineering and model search for tables, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
