"""Banded-report engine: operators."""
