"""Spark-first retrieval analytics: chunking, vector and text search, fusion, evaluation."""

__version__ = "0.1.0"
