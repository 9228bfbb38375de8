"""Condition-monitoring analytics on Spark: DataFrame-to-DataFrame operators."""
