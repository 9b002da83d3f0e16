"""Operators bound to the shared test tables, each with the SQL that must give the same rows."""

from . import registry

registry.load()
QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
