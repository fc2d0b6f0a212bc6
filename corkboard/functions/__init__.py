"""Functions of the note engine."""
