"""Spark-native program-graph engine."""
