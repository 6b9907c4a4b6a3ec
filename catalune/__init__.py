"""Spark-native analytics for catalog-style data."""
