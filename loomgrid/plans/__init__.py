"""All queries of the engine, by family; importing a family registers its queries."""

from loomgrid.plans import accounts, clusters, graphs, lookups, payloads, places, resolution, scans, texts
from loomgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "accounts", "clusters", "graphs", "lookups", "payloads", "places", "resolution", "scans", "texts"]
