"""Operators over scene tables: DataFrame in, DataFrame out."""
