"""plans of the places engine."""
