"""Operators of the audit: DataFrame to DataFrame, in Spark SQL."""
