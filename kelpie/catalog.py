"""All queries of the library by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpie.plans import knowledge_queries, merge_queries, note_queries, record_queries, search_queries, selection_queries, stream_queries, view_queries  # noqa: F401  the modules share one list

FLAGSHIP = "a1_time_per_tag_day"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(record_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(record_queries.SQL)
