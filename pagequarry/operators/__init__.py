"""Operators over DataFrames of pages, sections, queries and hits."""
