"""Terrane: a PySpark-native engine for business-places data."""
