"""All queries of the package, with their oracle SQL."""

from tesserql.queries import aggregates, joins, others, scalars, scans, sorts, subqueries, text_functions, texts, windows  # noqa: F401
from tesserql.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
