"""Operators: DataFrame in, DataFrame out. They choose grouping and windows; the maths is in functions."""
