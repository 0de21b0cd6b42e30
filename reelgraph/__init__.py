"""Spark-native analytics over multimodal media collections and their knowledge graphs."""

__version__ = "0.1.0"
