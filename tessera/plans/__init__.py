"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from tessera.plans import dashboards, graph, listings, snapshots, storage, versions
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "dashboards", "graph", "listings", "snapshots", "storage", "versions"]
