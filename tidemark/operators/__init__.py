"""Operators for timeline data."""
