"""Spark-native redundancy, contamination and catalogue analytics."""
