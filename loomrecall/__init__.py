"""Spark-native retrieval analytics: search indexes, record stores, code graphs and event rollups as DataFrame jobs."""

__version__ = "0.1.0"
