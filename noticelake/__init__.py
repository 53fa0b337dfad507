"""Spark-native analytics for notice and document collections."""
