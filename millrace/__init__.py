"""Spark-native data preparation, profiling and corpus building."""
