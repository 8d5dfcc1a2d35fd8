"""Operators over pixel tables: DataFrame to DataFrame, keyed by scene."""
