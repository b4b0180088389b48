"""Runs of repeated words: all maximal periodic stretches of a text, and the text with their repeats taken out.

A run is a stretch of consecutive words with smallest period q, at least ``least_periods`` * q and ``least_words`` words
long, that no neighbouring word extends with that period. Words are what stands between ASCII white space.

1. Harmonic grid. A run of period p and length 4p holds 3p consecutive places i with word i = word i + p, so one of every
   3p places is among them. For each p the pairs (i, i + p) on that grid are tried: n/3 * ln n pairs for n words.
2. Longest common extension of such a pair, to the right and to the left. Words are compared one by one, until both
   places reach a sample of the difference cover at once (at most 15 words); most pairs differ before that. The rest is
   read off the sorted samples: the least of the common prefixes between the two, by a sparse table.
3. Only the samples of a difference cover modulo 16 (5 places of 16) are sorted, and only for texts in which some pair
   got that far: first by their next 16 words, then by doubling over the samples that follow. The common prefixes
   of neighbours in that order come from the ranks that the doubling leaves behind.
4. Pairs that extend far enough are runs. The same stretch under a multiple of its period is found too; the smallest
   period of each stretch is kept.

Texts are taken together in batches of bounded size, so NumPy works on long arrays; a single longer text is a batch of its
own, whose grid is taken in slices. Null and empty texts have no words and no runs. Rows with equal or null ids are each worked on by
themselves, columns other than the two named are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

V = 16
#: Every distance modulo 16 lies between two of these places.
COVER = np.array([0, 1, 2, 5, 8])


def _reach_table() -> np.ndarray:
    """For places i and j modulo V, the fewest words to skip until both are samples."""
    inside = np.isin(np.arange(V), COVER)
    steps = np.arange(V)
    i, j = np.meshgrid(steps, steps, indexing="ij")
    both = inside[(i[..., None] + steps) % V] & inside[(j[..., None] + steps) % V]
    return both.argmax(2)


REACH = _reach_table()
SLOT = np.full(V, -1)
SLOT[COVER] = np.arange(len(COVER))


class Samples:
    """Common prefixes of sampled places of a sequence, in constant time each.

    ``words``: codes, padded with V codes that occur nowhere else; ``owner``: the text of each place, so that samples
    of different texts never tie.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, longest: int):
        self.words = words
        blocks = (len(words) - V) // V + 1
        self.places = (np.arange(blocks)[:, None] * V + COVER).ravel()
        self.places = self.places[self.places <= len(words) - V]
        names = self._tuples(owner)
        self.levels = [names.astype(np.int32)]
        span = 1  # in samples of the same place of the cover
        while span * V < longest and len(np.unique(names)) < len(names):
            shifted = np.full(len(names), -1)
            step = span * len(COVER)
            if step < len(names):
                shifted[:-step] = names[step:]
            names = np.unique(names * (len(names) + 1) + shifted + 1, return_inverse=True)[1]
            self.levels.append(names.astype(np.int32))
            span *= 2
        order = np.argsort(names, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [self._neighbours(order)]
        self.levels = []
        while 2 << (len(self.table) - 1) <= len(order):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _tuples(self, owner: np.ndarray) -> np.ndarray:
        """Numbers of the samples' next V words, in their order."""
        bits = max(int(self.words.max()).bit_length(), 1)
        each = 62 // bits
        keys = [owner[self.places]]
        for start in range(0, V, each):
            key = np.zeros(len(self.places), np.int64)
            for k in range(start, min(start + each, V)):
                key = key << bits | self.words[self.places + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            sorted_key = key[order]
            new[1:] |= sorted_key[1:] != sorted_key[:-1]
        names = np.empty(len(order), np.int64)
        names[order] = np.cumsum(new)
        return names

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """The common prefix of each sample in the order with the one before it, in words."""
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[level], len(COVER) << level
            fits = (a < len(names)) & (b < len(names))
            same = fits.copy()
            same[fits] = names[a[fits]] == names[b[fits]]
            a[same] += step
            b[same] += step
            length[same] += V << level
        open_ = np.flatnonzero((a < len(self.places)) & (b < len(self.places)))
        for k in range(V):
            equal = self.words[self.places[a[open_]] + k] == self.words[self.places[b[open_]] + k]
            open_ = open_[equal]
            length[open_] += 1
        return np.concatenate([[0], length]).astype(np.int32)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of two sampled places each."""
        a, b = (self.rank[x // V * len(COVER) + SLOT[x % V]] for x in (i, j))
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.log2(high - low + 1).astype(np.int64)
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


class Extension:
    """Longest common extensions to the right inside texts that stand one after another."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, longest: int):
        most = int(words.max()) + 1
        self.words = np.concatenate([words, np.arange(most, most + 2 * V)])
        self.owner = np.concatenate([owner, np.full(2 * V, -1)])
        self.longest, self.samples = longest, None

    def direct(self, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words are equal before both are samples, and for which pairs that leaves more to ask for."""
        reach = REACH[i % V, j % V]
        found = np.zeros(len(i), np.int64)
        open_ = np.arange(len(i))
        for k in range(V):
            ended = (reach[open_] <= k) | (room[open_] <= k)
            if ended.any():
                open_ = open_[~ended]
            if not len(open_):
                break
            open_ = open_[self.words[i[open_] + k] == self.words[j[open_] + k]]
            found[open_] = k + 1
        return found, (found >= reach) & (room > found)

    def lengths(self, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Equal words from i and j (i < j) on; ``room``: words from j to the end of its text."""
        found, more = self.direct(i, j, room)
        if more.any():
            if self.samples is None:
                self.samples = Samples(self.words, self.owner, self.longest)
            more = np.flatnonzero(more)
            skip = found[more]
            found[more] = skip + self.samples.common(i[more] + skip, j[more] + skip)
        return np.minimum(found, room)


def grid(sizes: np.ndarray, starts: np.ndarray, least_periods: int, slice_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (place, period, number of the text) over the harmonic grids of all texts."""
    periods = sizes // least_periods
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (least_periods - 1) * period
    count = -(-(sizes[text] - period) // step)
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slice_pairs, "right")), at + 1)
        times = count[at:upto]
        which = np.repeat(np.arange(at, upto), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        yield starts[text[which]] + nth * step[which], period[which], text[which]
        at = upto


def find_runs(words: np.ndarray, sizes: np.ndarray, least_periods: int = 4, least_words: int = 6, slice_pairs: int = 1 << 20) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period. ``words``: the texts' codes one after another."""
    none = np.empty((0, 4), np.int64)
    if not len(words):
        return none
    starts = np.cumsum(sizes) - sizes
    longest = int(sizes.max())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    size = len(words)
    right = left = None
    parts = []
    for place, period, text in grid(sizes, starts, least_periods, slice_pairs):
        same = words[place] == words[place + period]
        place, period, text = place[same], period[same], text[same]
        if not len(place):
            continue
        # a pair that extends to neither side by words alone needs no samples
        right = right or Extension(words, owner, longest)
        left = left or Extension(words[::-1], owner[::-1], longest)
        need = np.maximum((least_periods - 1) * period, least_words - period)
        mirror = size - place - period  # the word before place + period, read backwards
        back_room = place - starts[text]
        room = starts[text] + sizes[text] - place - period
        found, more = right.direct(place, place + period, room)
        before, more_before = left.direct(mirror, mirror + period, back_room)
        far = more | more_before | (found + before >= need)
        place, period, text, need, mirror, back_room, room = (x[far] for x in (place, period, text, need, mirror, back_room, room))
        found = right.lengths(place, place + period, room)
        before = left.lengths(mirror, mirror + period, back_room)
        far = found + before >= need
        begin = (place - before)[far]
        parts.append(np.column_stack([text[far], begin - starts[text[far]], (period + before + found)[far], period[far]]))
    if not parts:
        return none
    runs = np.unique(np.concatenate(parts), axis=0)  # by text, start, length, period
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay if each run (start, length, period) is cut to its first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """The digest columns of one text from its runs (start, length, period)."""
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    if len(runs):
        best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        words = [w for w, keep in zip(words, kept_words(len(words), runs).tolist()) if keep]
        top = (*best, 1000 * best[1] // best[2])
    else:
        top = (None, None, None, None)
    return len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def split_words(text: str | None) -> list[bytes]:
    """What stands between ASCII white space; other white space belongs to words."""
    return text.encode().split() if text else []


def _mapped(df: DataFrame, id_col: str, text_col: str, schema: str, of_text, prepare, batch_words: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def done(ids, texts):
        codes: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts])
        words = np.fromiter((codes.setdefault(w, len(codes)) for t in texts for w in t), np.int64, int(sizes.sum()))
        runs = find_runs(words, sizes)
        edges = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        rows = [
            (key, *of_text(text, runs[a:b, 1:])) for key, text, a, b in zip(ids, texts, edges[:-1], edges[1:])
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                words = prepare(key, split_words(batch.column(1)[i].as_py()))
                if ids and held + len(words) > batch_words:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(words)
                held += len(words) + 8
        if ids:
            yield done(ids, texts)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def unchanged(key, words: list[bytes]) -> list[bytes]:
    return words


def run_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare=unchanged, batch_words: int = 1 << 16
) -> DataFrame:
    """One row per row: doc_id, n_runs, the longest run (start, length, period, exponent_milli) and two digests.

    ``prepare(id, words)`` gives the words to look at.
    """
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return _mapped(df, id_col, text_col, schema, summary, prepare, batch_words)


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_words: int = 1 << 16) -> DataFrame:
    """One row per row: doc_id, the runs and the text with each run cut to its first period, words joined by one space.

    A null text stays null."""

    def of_text(words, runs):
        kept = kept_words(len(words), runs).tolist()
        spans = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
        return spans, b" ".join(w for w, keep in zip(words, kept) if keep).decode()

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    present = df.where(df[text_col].isNotNull())
    absent = df.where(df[text_col].isNull()).selectExpr(f"cast({id_col} as long) doc_id", "cast(null as array<struct<start:long,length:long,period:long>>) runs", "cast(null as string) collapsed")
    return _mapped(present, id_col, text_col, schema, of_text, unchanged, batch_words).unionByName(absent)
