"""Banded-report analytics on Spark."""
