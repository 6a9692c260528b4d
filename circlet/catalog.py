"""Registered queries of the sequence engine and their oracle SQL."""

from circlet.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
