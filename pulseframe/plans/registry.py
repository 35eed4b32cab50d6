"""All queries of the library and their SQL."""

from __future__ import annotations

from pulseframe.plans import catalogue, catalogue_sources, catalogue_streams

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue_sources", "catalogue_streams"]
