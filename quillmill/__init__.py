"""Spark-native engine that turns document collections into reviewed datasets."""
