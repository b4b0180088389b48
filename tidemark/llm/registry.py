"""All queries of this subpackage; importing the query modules registers them."""

from tidemark.llm import licence_queries, other_queries, overlap_queries, structure_queries, text_queries, token_queries  # noqa: F401
from tidemark.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
