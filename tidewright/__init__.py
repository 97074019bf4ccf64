"""Spark-native analytics for road-level hazard over time."""
