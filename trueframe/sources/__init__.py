"""Readers, JSON flatteners and sinks."""
