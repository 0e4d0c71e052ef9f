"""Whole programs, and the queries over the driver's tables."""
