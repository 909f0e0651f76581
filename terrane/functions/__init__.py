"""Scalar and array functions built from Spark's own expressions."""
