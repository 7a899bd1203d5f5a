"""Corpus indexing, retrieval and navigation over Spark DataFrames."""

__version__ = "0.1.0"
