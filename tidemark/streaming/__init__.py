"""Streaming for timeline data."""
