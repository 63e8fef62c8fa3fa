"""Readers, derived tables and sinks."""
