"""Stored tables."""

from tidemark.sources.tables import ConflictError, Table

__all__ = ["ConflictError", "Table"]
