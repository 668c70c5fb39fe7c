"""Spark-native log analytics: DataFrame operators over log lines."""
