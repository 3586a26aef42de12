"""Spark-native corpus preparation, deduplication, scoring and audit analytics."""
