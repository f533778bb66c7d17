"""Operators on regions, intervals, cells and rows."""
