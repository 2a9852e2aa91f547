"""Registered queries of the core library."""

from corpusloom.plans import analytics, joins, retrieval, scans, streams, texts  # noqa: F401
from corpusloom.plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "bm25_search"
