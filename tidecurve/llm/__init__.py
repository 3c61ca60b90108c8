"""Operators for preparing model training data.  Nothing outside this package imports it."""
