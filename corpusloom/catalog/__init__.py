"""All registered queries with their SQL statements."""

from corpusloom.catalog import answering, evaluation, flows, ingest, retrieval, storage, training  # noqa: F401
from corpusloom.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
