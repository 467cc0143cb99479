"""Offer and price analytics, and training-data preparation, as Spark DataFrame pipelines."""
