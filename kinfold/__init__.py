"""Identity resolution and text-corpus analytics, planned as Spark DataFrames."""

__version__ = "0.1.0"
