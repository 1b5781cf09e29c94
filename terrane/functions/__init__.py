"""functions of the places engine."""
