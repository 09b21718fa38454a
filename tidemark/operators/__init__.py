"""Operators: DataFrame in, DataFrame out. Every order has a total tie key."""
