"""Operators of a training-data pipeline. Nothing outside this folder imports them.

``QUERIES`` binds each operator to the shared tables with production parameters and ``ORACLES``
holds the SQL for those that SQL can express.
"""

from .bound import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
