"""All registered queries."""

from attesta.queries import chunks, citations, ingest, layout, retrieval, streaming, topics, tree  # noqa: F401
from attesta.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
