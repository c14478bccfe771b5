"""Corpus-scale document linting, repair and conversion on PySpark."""

__version__ = "0.2.0"
