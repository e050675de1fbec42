"""Audit of very large tables of source files and documents, as Spark DataFrame operators."""

__version__ = "0.1.0"
