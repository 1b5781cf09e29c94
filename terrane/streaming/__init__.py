"""streaming of the places engine."""
