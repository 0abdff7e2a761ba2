"""Spark-native analytics over append-only evidence ledgers."""
