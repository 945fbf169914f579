"""Spark-native analytics engine: sources."""
