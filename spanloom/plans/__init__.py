"""Logical plans: layouts of bins and the matrix."""
