"""Spark-native claim verification analytics."""
