"""All queries of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "effective_activity_aggregate"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) by its name, with its oracle."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


from tidemark.plans import activity, banks, calendar, chapters, enrichment, gates, ingest, lineage, listing, outline, practice, quality, recall, review, search, sequences, statistics, structure, study, summary, terms, text  # noqa: E402, F401
