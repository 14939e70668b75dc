"""Operators over DataFrames: linking, splitting, near-duplicates, retrieval, media rules."""
