"""Spark-native analytics for price bars, trades, features and parameter sweeps."""
