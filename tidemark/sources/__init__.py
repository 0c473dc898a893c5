"""Sources for timeline data."""
