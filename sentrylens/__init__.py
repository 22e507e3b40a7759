"""Spark-native alert analytics and label audit."""
