"""Stateful and incremental jobs."""
