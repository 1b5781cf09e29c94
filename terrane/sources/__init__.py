"""sources of the places engine."""
