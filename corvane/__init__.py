"""Spark-first feature engineering for secondary-market listing data."""
