"""Spark-native analytics over per-frame visual observations."""
