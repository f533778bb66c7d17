"""Readers of regions, signal and written matrices."""
