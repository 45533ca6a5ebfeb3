"""Spark-native machine-learning analytics over tables."""
