"""Catalog documents, grid files and the source registry."""
