"""Spark-native analytics engine: plans."""
