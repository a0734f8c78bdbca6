"""All reference-style queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put



# each module registers its queries as it is imported
from sparrowgrid.plans import aggregates, changes, clients, clusters, entities, facts, gates, names, places, projects, ranked, register, relations, reports, screens, sections, streams, texts  # noqa: E402, F401
