"""Novelty and impact analytics over dated text corpora, written as Spark jobs."""

from tidemark.operators.windows import WindowSpec

__all__ = ["WindowSpec"]
