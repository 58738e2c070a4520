"""Spark-native engine for building, searching and judging text corpora."""
