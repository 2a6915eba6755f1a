"""Spark-native analytics for evaluations of language models."""

__version__ = "0.1.0"
