"""Schemas, readers, writers and the binding of role tables."""
