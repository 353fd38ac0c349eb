"""Ranked, symbol-aware search over versioned document collections, on Spark DataFrames."""
