"""All registered queries of the library's own operators."""

from framewatch.plans import queries_analytics, queries_rules  # noqa: F401
from framewatch.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
