"""Operators of the note engine."""
