"""Queries that take several operators: the tools of the event graph, and evaluation prepared from records. Importing this registers them."""

from trackloom.catalog import ORACLE_SQL, QUERIES
from trackloom.plans import evaluating, filing, graph, preparing

__all__ = ["ORACLE_SQL", "QUERIES", "evaluating", "filing", "graph", "preparing"]
