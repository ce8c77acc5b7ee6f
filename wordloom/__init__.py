"""Spark-native word-list search and analytics."""
