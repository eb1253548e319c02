"""Queries opN over the given tables."""
