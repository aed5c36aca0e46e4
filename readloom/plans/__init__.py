"""Registered queries over the given tables, with the SQL that checks them."""

from readloom.plans import model_queries, pair_queries, site_queries, strain_queries  # noqa: F401  (they register their queries)
from readloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
