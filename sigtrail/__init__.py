"""Evidence analytics on Spark: scans, gates, joins, similarity and statistics as DataFrames."""

__version__ = "0.1.0"
