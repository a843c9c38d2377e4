"""All queries of the corpus operators."""

from attesta.llm import model_queries, native_queries, structure_queries, text_queries, token_queries  # noqa: F401
from attesta.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
