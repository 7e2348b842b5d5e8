"""Banded-report engine: streaming."""
