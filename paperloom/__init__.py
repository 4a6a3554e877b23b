"""Spark-native analytics over scholarly metadata."""
