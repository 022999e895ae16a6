"""Spark-first analytics and model evaluation for time-ordered event tables."""
