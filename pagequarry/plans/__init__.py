"""Whole conversions, put together from operators."""
