"""All registered queries of the library proper."""

from obsgrain.plans import data_queries, stat_queries  # noqa: F401
from obsgrain.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
