"""Operators: DataFrame (+ parameters) in, DataFrame out."""
