"""Structured Streaming jobs: positions, news capture, visibility, corrections."""
