"""Tidemark: Spark-native operators for versioned, point-in-time data."""
