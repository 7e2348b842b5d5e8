"""Banded-report engine: plans."""
