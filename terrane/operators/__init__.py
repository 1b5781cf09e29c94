"""operators of the places engine."""
