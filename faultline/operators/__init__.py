"""Operators over DataFrames: filters, alignment, features, retrieval, graphs, rules and reports."""
