"""Whole audits made of the operators."""
