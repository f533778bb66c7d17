"""Scalar functions on columns and on values."""
