"""The engine's registered queries and the SQL that each is held against."""

from __future__ import annotations

from palate.plans import extra, more, scores, similar, social, taste  # noqa: F401
from palate.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["recommend_metadata"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
