"""Feedback analytics operators: DataFrame in, DataFrame out, lazy."""
