"""Spark-native processing of HTML documents."""
