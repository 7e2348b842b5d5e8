"""Banded-report engine: sources."""
