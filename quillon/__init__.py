"""Spark-native document privacy, tabular privacy and regulatory-text analytics."""
