"""Operators over DataFrames: indexing, search, fusion, answers, catalogue."""
