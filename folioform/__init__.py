"""folioform: a Spark-first engine for structured text corpora."""

__version__ = "0.1.0"
