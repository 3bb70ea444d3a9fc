"""Spark-native engine for interval time-series results."""
