"""Readers, writers and the views derived from the base tables."""
