"""All queries of the point-cloud engine, with their SQL."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "AG16"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
