"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of every document.

Index. A posting's weight is the BM25 impact of a term in an item, divided by the item's score of itself, so a passage's
score is the share of an item's weight that the passage holds and one threshold serves all items. Postings are ordered
by item; items fall into ranges, and each term keeps its largest weight in each range.

Queries. A document's words are cut into overlapping windows so that an item's words lie in one window wherever they
start. First, sums of the maxima in a few coarse ranges bound each window's score, all windows at once; the finer ranges
bound what is left. Windows that can reach the threshold go through block-max WAND: lists in order of their next item, the pivot where the lists'
maxima reach the threshold, a skip to the end of the range if the range maxima do not. Every item above the threshold
is returned, there is no top k. Then question and answer are verified: the answer is an item's last sentence (or
its last fifth), and of both parts enough word 3-grams must stand in the window.

The benchmark is cut into parts of about ``part_words`` words by hash; each part's index is broadcast and scans all
documents, so what is broadcast does not grow with the benchmark. Document frequencies come from the whole benchmark.

Null texts, and texts and items without words, match nothing. Rows with null item ids take no part; of several items of one
id each is an item. Every document row is reported for itself, also if its id is null or repeated. Equal items are all
reported. Columns other than the named ones are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import release
from tidemark.llm.text_map import keep_rows

WORD = re.compile(r"[^\W_]+").findall
K1, B = 1.2, 0.75
RANGES, CELLS = 32, 2_000_000  # coarse ranges of items, and the size of the table of maxima in the fine ones
SCHEMA = "doc_id long, item_id long, score double, question double, answer double"


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence and those of the last sentence; the last fifth if there is one sentence."""
    sentences = [w for w in (WORD(s) for s in re.split(r"[.!?]+\s", text.lower().strip())) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share_inside(part: list[str], text: list[str]) -> float:
    """The share of a part's word 3-grams (fewer words: of the whole part) that the text holds; 1 for an empty part."""
    wanted = grams(part)
    return len(wanted & grams(text, min(3, len(part)))) / len(wanted) if wanted else 1.0


@dataclass
class Posting:
    items: list[int]
    weights: list[float]
    most: float


class Index:
    """The inverted index of a part of the benchmark; see the module's text."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], total: int, mean_length: float):
        words = [(key, text, WORD(text.lower())) for key, text in items]
        words = sorted((w for w in words if w[2]), key=lambda w: (w[0], w[1]))
        self.keys = [key for key, _, _ in words]
        self.parts = [question_and_answer(text) for _, text, _ in words]
        self.longest = max((len(w) for _, _, w in words), default=1)
        self.terms: dict[str, int] = {}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for number, (_, _, w) in enumerate(words):
            impact = {}
            for term, tf in Counter(w).items():
                n = frequency.get(term, 1)
                idf = math.log(1 + (total - n + 0.5) / (n + 0.5))
                impact[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_length))
            own = sum(impact.values())
            for term, value in impact.items():
                lists[self.terms.setdefault(term, len(self.terms))].append((number, value / own))
        self.postings = [Posting([i for i, _ in lists[t]], [v for _, v in lists[t]], max(v for _, v in lists[t])) for t in range(len(lists))]
        ranges = max(RANGES, min(len(words), CELLS // max(len(lists), 1)) // RANGES * RANGES)
        self.span = max(1, -(-len(words) // ranges))  # items in a range
        self.most = np.zeros((len(lists), ranges), np.float32)
        for term, found in lists.items():
            for item, value in found:
                self.most[term, item // self.span] = max(self.most[term, item // self.span], value)
        self.coarse = self.most.reshape(len(lists), RANGES, ranges // RANGES).max(2)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of at least the threshold, by block-max WAND over the distinct terms."""
        lists = [[self.postings[t].items[0], 0, t] for t in terms]  # next item, cursor, term
        found = []
        goal = threshold - 1e-6

        def advance(entry: list, item: int) -> None:
            items = self.postings[entry[2]].items
            at = bisect_left(items, item, entry[1])
            entry[0], entry[1] = items[at] if at < len(items) else len(self.keys), at

        while True:
            lists = sorted(e for e in lists if e[0] < len(self.keys))
            bound, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                bound += self.postings[entry[2]].most
                if bound >= goal:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // self.span
            if sum(float(self.most[e[2], block]) for e in lists[: pivot + 1]) < goal:
                upto = (block + 1) * self.span  # no item of this range, unless a later list joins in
                if pivot + 1 < len(lists):
                    upto = min(upto, lists[pivot + 1][0])
                for entry in lists[: pivot + 1]:
                    advance(entry, max(upto, item + 1))
            elif lists[0][0] == item:
                score = sum(self.postings[e[2]].weights[e[1]] for e in lists[: pivot + 1])
                if score >= goal:
                    found.append((item, score))
                for entry in lists[: pivot + 1]:
                    advance(entry, item + 1)
            else:
                for entry in lists[:pivot]:
                    if entry[0] < item:
                        advance(entry, item)

    def matches(self, text: str, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, score, share of the question, share of the answer) of the items that the text holds."""
        words = WORD(text.lower())
        codes = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(codes >= 0)
        if not len(places):
            return []
        step, size = max(32, self.longest), len(self.most)
        # each word once in every stretch of ``step`` words; a window is two stretches, from one start to the next but one
        stretch_words = np.unique(places // step * size + codes[places])
        stretches, terms = stretch_words // size, stretch_words % size
        best: dict[int, tuple[float, float, float]] = {}
        count = max(1, -(-len(words) // step) - 1)
        for first in range(0, count, 512):  # a bounded slice of a very long text
            lo, hi = np.searchsorted(stretches, (first, min(first + 512, count) + 1))
            sums = np.zeros((min(512, count - first) + 1, RANGES), np.float32)
            if hi > lo:
                starts = np.flatnonzero(np.diff(stretches[lo:hi], prepend=-1))
                sums[stretches[lo:hi][starts] - first] = np.add.reduceat(self.coarse[terms[lo:hi]], starts, axis=0)
            for k in first + np.flatnonzero((sums[:-1] + sums[1:] >= threshold - 1e-4).any(1)):
                own = np.unique(terms[np.searchsorted(stretches, k) : np.searchsorted(stretches, k + 2)])
                if self.most[own].sum(0, dtype=np.float64).max(initial=0) < threshold - 1e-4:
                    continue
                window = words[k * step : (k + 2) * step]
                for item, score in self.search(own.tolist(), threshold):
                    question, answer = (share_inside(part, window) for part in self.parts[item])
                    if question >= overlap and answer >= overlap and score > best.get(item, (0.0,))[0]:
                        best[item] = score, question, answer
        return [(self.keys[item], *best[item]) for item in sorted(best)]


def indexes(benchmark: DataFrame, part_words: int) -> Iterator[Broadcast]:
    """The index of each part of the benchmark, broadcast. A part has about ``part_words`` words."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    sized = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(words)).alias("words")).first()
    total, length = sized["n"], sized["words"] or 0
    parts = max(1, -(-length // part_words))
    frequency = items.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for number in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == number)
        terms = own.select(F.explode(words).alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in frequency.join(terms, "term").collect()}  # at most part_words terms
        rows = [(r["item_id"], r["text"]) for r in own.collect()]  # about part_words words
        yield spark.sparkContext.broadcast(Index(rows, counts, total, max(length / max(total, 1), 1.0)))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, part_words: int = 1_000_000
) -> DataFrame:
    """(doc_id, item_id, score, question, answer): a row for each document and each test item that it holds."""
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "item_id", "score", "question", "answer"]

    def scan(index: Broadcast) -> DataFrame:
        def run(batches):
            for batch in batches:
                out = [
                    (doc, *m)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for m in (index.value.matches(text, threshold, overlap) if text else [])
                ]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(scan, indexes(benchmark, part_words)))


def keep_unleaked(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, part_words: int = 1_000_000
) -> DataFrame:
    """The rows, with all their columns, whose text holds no test item."""
    for index in indexes(benchmark, part_words):

        def make(index=index):
            release()
            return lambda text: not (text and index.value.matches(text, threshold, overlap))

        docs = keep_rows(docs, "text", make)
    return docs
