"""Derived test corpora and other inputs, computed by Spark from the given tables."""
