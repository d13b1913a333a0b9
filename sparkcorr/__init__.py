"""Spark-native lagged-correlation analytics."""
