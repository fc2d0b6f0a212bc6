"""Sources of the note engine."""
