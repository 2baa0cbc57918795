"""Scalar functions on columns and options."""
