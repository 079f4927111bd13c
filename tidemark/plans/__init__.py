"""Ready-made queries over the sample tables, each with an SQL twin."""

from tidemark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
