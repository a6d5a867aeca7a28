"""Tidemark: web-search analytics and data processing as Spark DataFrame plans."""

__version__ = "0.1.0"
