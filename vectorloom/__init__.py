"""Spark-native analytics for federated hypervector classification and training data."""
