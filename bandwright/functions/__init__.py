"""Banded-report engine: functions."""
