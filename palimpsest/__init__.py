"""Palimpsest: batch retrieval, ranking and data preparation over versioned repository memory, on Spark."""

__version__ = "0.1.0"
