"""Retrieval, normalization and training-data operators over Markdown documentation, on Spark."""

__version__ = "0.1.0"
