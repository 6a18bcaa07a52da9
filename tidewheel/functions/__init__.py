"""Scalar functions and window statistics."""
