"""Spark-native text embedding, vector and corpus analytics."""

__version__ = "0.1.0"
