"""Spark-native sync planning and delta analytics."""
