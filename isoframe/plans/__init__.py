"""Analyst queries over the published tables."""
