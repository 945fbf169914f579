"""Spark-native analytics engine: streaming."""
