"""Plans of the note engine."""
