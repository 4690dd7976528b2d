"""Column-in, Column-out rules; no Python per row."""
