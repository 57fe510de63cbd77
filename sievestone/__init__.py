"""Data-quality analytics for machine-learning tables, as Spark DataFrame operators."""
