"""Queries over the driver's tables, by name, and their SQL."""

from .queries import QUERIES
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
