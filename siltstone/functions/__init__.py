"""Spark-native analytics engine: functions."""
