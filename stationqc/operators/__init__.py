"""Operators: DataFrame to DataFrame, lazy."""
