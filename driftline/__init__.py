"""Spark-native analytics over entity-by-date panels and dated events."""
