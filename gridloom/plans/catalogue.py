"""All queries of the engine by name, and the SQL each must agree with."""

from __future__ import annotations

from gridloom.plans import files, key_queries, load, monitoring, nodes, spatial
from gridloom.plans.tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "key_queries", "load", "monitoring", "nodes", "spatial"]
