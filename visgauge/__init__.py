"""Evaluation analytics for saved predictions, as Spark DataFrame operators."""
