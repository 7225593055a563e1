"""Runnable queries over the test tables, each with its equivalent SQL where SQL can say it."""

from areapanel.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    columns,
    evaluation,
    featuresets,
    filters,
    ingest,
    joins,
    learning,
    linear,
    ranks,
    trees,
)
from areapanel.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
