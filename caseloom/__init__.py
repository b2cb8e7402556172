"""Spark-first case, text, dataset and evaluation analytics."""
