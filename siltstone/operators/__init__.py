"""Spark-native analytics engine: operators."""
