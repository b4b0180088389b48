"""Token counts by byte-pair merging, without building the tokens.

Every piece of a text starts as its bytes in a doubly linked list. A heap holds the adjacent pairs that
the vocabulary can merge, lowest rank first and leftmost among equals; popping one merges it and pushes
its two new neighbours. The count of a piece is its bytes less its merges, so no id is ever looked up.

Nulls count as empty texts: no bytes, no tokens. Ids may repeat or be null; each row is counted by
itself. Columns other than the two named are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from tidemark.llm.pieces import Memo, splitter
from tidemark.llm.text_map import map_rows

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


SHIFT = 32


def merged_count(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """The number of symbols left when no pair can be merged any more.

    ``ranks`` has the rank of a pair by ``left << SHIFT | right``, ``merged`` the symbol that a rank makes. ``at[i]`` is the
    rank of the pair that now starts at i, so a popped entry of another rank is out of date.
    """
    size = left_over = len(symbols)
    following, previous = list(range(1, size + 1)), list(range(-1, size - 1))
    rank_of, push, pop = ranks.get, heapq.heappush, heapq.heappop
    at = [rank_of(a << SHIFT | b, -1) for a, b in zip(symbols, symbols[1:])]
    at.append(-1)
    heap = [rank << SHIFT | i for i, rank in enumerate(at) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> SHIFT
        if at[i] != rank:
            continue
        j = following[i]
        symbol = symbols[i] = merged[rank]
        k = following[i] = following[j]
        at[j] = at[i] = -1
        left_over -= 1
        if k < size:
            previous[k] = i
            at[i] = rank = rank_of(symbol << SHIFT | symbols[k], -1)
            if rank >= 0:
                push(heap, rank << SHIFT | i)
        h = previous[i]
        if h >= 0:
            at[h] = rank = rank_of(symbols[h] << SHIFT | symbol, -1)
            if rank >= 0:
                push(heap, rank << SHIFT | h)
    return left_over


class Counter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        ids = vocabulary["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in vocabulary["model"]["merges"]]
        self.ranks = {ids[a] << SHIFT | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        self.bytes = [ids[letter] for letter in byte_letters()]
        self.pieces = splitter(pattern)
        specials = sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.of_piece = Memo(self.piece_count)

    def piece_count(self, piece: str) -> int:
        return merged_count([self.bytes[b] for b in piece.encode()], self.ranks, self.merged)

    def count(self, text: str) -> int:
        """The library's count: strings of added tokens are one token each and separate what stands around them."""
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.of_piece.__getitem__, self.pieces(p))) for p in parts)


@lru_cache(2)
def counter_of(path: str, pattern: str) -> Counter:
    """One counter in a process: tasks that follow each other use what it remembers."""
    return Counter(path, pattern)


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text; ``over_limit`` marks texts of more than ``limit`` tokens."""

    def worker():
        counter = counter_of(path, pattern)

        def row(key, text):
            text = text or ""
            tokens = counter.count(text)
            return key, len(text.encode()), tokens, tokens > limit

        return row

    return map_rows(df, [id_col, text_col], SCHEMA, worker)
