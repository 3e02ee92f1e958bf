"""Scalar functions on text, as native column expressions."""
