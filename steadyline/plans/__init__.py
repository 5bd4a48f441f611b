"""Registered queries, by name, and the SQL that must give the same rows."""

from .registry import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
