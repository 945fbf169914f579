"""Spark-native analytics engine: package root."""
