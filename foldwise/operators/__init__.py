"""Operators: DataFrame in, DataFrame (and fitted table) out."""
