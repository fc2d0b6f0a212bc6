"""Streaming of the note engine."""
