"""lexmill: DataFrame operators for large text collections, their labels, vectors and statistics."""

__version__ = "0.1.0"
