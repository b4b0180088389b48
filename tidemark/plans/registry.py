"""All queries; importing the query modules registers them."""

from tidemark.plans import (  # noqa: F401
    code_queries,
    file_queries,
    grading_queries,
    score_queries,
    sweep_queries,
    text_queries,
    vector_queries,
)
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
