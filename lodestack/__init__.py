"""lodestack: build and score corpora of source code and documentation with Spark DataFrames."""

__version__ = "0.1.0"
