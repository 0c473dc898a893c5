"""Functions for timeline data."""
