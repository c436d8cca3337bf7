"""The registry of queries and their SQL."""

from __future__ import annotations

from kmerspark.plans import counting_queries, panel_queries, pcr_queries

QUERIES: dict = {**counting_queries.QUERIES, **pcr_queries.QUERIES, **panel_queries.QUERIES}
ORACLES: dict = {**counting_queries.SQL, **pcr_queries.SQL, **panel_queries.SQL}
