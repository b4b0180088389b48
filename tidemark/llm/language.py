"""Language of texts: known words first, character n-grams for the rest.

The model holds, for each language of the training rows, the frequencies of its words and of the character n-grams
of its words (their ends are marked). A word of the vocabulary adds its log frequency in each language. An unseen word
falls back to its longest n-grams that are known at all, from five letters down to one, and adds the mean of their log
frequencies. The language with the highest sum wins; the score is its share after a softmax of the mean per word over
at most ``evidence`` words.

The training rows are a bounded sample of each language (``sample_rows`` by hash, all rows of a language that has no
more; with many languages fewer of each, about ``all_rows`` together, but 200 at least), and all its words and n-grams are learnt. The model
holds an entry for each item and language that has it, so it grows with the sample and not with items times languages.
Texts that are null or have no letter are ``und`` with
score 0, as all texts are if nothing could be learnt. Languages that tie: the first by name. Rows with null languages or
texts teach nothing. Repeated or null ids are each predicted by themselves; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import resident
from tidemark.llm.text_map import keep_pieces, map_pieces, pieces_of
from tidemark.session import cut_lineage, fan_out

WORD = re.compile(r"[^\W\d_]+").findall
LONGEST = 5


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _added_up(batches, add) -> Iterator[pa.RecordBatch]:
    """Counts by language that ``add`` puts into Counters, sent on whenever they grow large."""
    counts: dict[str, Counter] = {}

    def flush():
        langs = [lang for lang, found in counts.items() for _ in range(len(found))]
        items = [i for found in counts.values() for i in found]
        n = [k for found in counts.values() for k in found.values()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(n, pa.int64())], names=["lang", "item", "n"])

    for batch in batches:
        for part in pieces_of(batch):
            for lang, *values in zip(*(c.to_pylist() for c in part.columns)):
                add(counts.setdefault(lang, Counter()), *values)
            if sum(map(len, counts.values())) > 50_000:
                yield flush()
    if counts:
        yield flush()


def _add_grams(found: Counter, word: str, n: int) -> None:
    for letter in word:
        found["\t" + letter] += n
    marked = f"^{word}$"
    for size in range(2, LONGEST + 1):
        for i in range(len(marked) - size + 1):
            found["\t" + marked[i : i + size]] += n


def count_rows(texts: DataFrame, languages: str, text_col: str) -> DataFrame:
    """(lang, item, n): words, and n-grams behind a tab; added up in each task before the shuffle. Words are cut into n-grams
    once, after they were added up."""
    kind = "lang string, item string, n long"
    add_words = lambda found, text: found.update(WORD(text.lower()))
    words = texts.select(languages, text_col).mapInArrow(lambda b: _added_up(b, add_words), kind)
    words = cut_lineage(words.groupBy("lang", "item").agg(F.sum("n").alias("n")))
    shares = fan_out(words, "lang", "item").mapInArrow(lambda b: _added_up(b, _add_grams), kind)
    return words.unionByName(shares.groupBy("lang", "item").agg(F.sum("n").alias("n")))


class Vocabulary:
    """Log frequencies of items by language. A language that lacks an item has its ``base``; the others stand in
    compressed rows, as differences from it. Names stay in one Arrow array until a task looks them up."""

    def __init__(self, counted: pa.Table, languages: int):
        """``counted``: lang (a number), item, n; each pair once."""
        counted = counted.sort_by([("item", "ascending"), ("lang", "ascending")])
        items = counted.column("item").combine_chunks()
        langs, counts = counted.column("lang").to_numpy(), counted.column("n").to_numpy().astype(float)
        new = np.ones(len(items), bool)
        if len(items) > 1:
            new[1:] = pc.not_equal(items[1:], items[:-1]).to_numpy(zero_copy_only=False)
        self.names = items.filter(pa.array(new))
        totals = np.bincount(langs, counts, languages) + 0.5 * len(self.names)
        self.base = np.log(0.5 / np.maximum(totals, 0.5))
        self.starts = np.append(np.flatnonzero(new), len(items)).astype(np.int64)
        self.langs = langs.astype(np.int32 if languages > 1 << 15 else np.int16)
        self.above = np.log((counts + 0.5) / 0.5).astype(np.float32)

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """The items' hashes in order, and whose they are: a few bytes an item, where a dictionary would take a hundred."""
        hashes = np.empty(len(self.names), np.uint64)
        for start in range(0, len(hashes), 1 << 16):
            part = self.names.slice(start, 1 << 16).to_pylist()
            hashes[start : start + len(part)] = np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], order

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def find(self, items: list[str]) -> np.ndarray:
        """The rows of items; -1 for unknown ones. Names decide, not hashes."""
        rows = np.full(len(items), -1)
        hashes, order = self.index
        if not len(items) or not len(hashes):
            return rows
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items))
        at = np.searchsorted(hashes, wanted)
        open_ = np.flatnonzero(at < len(hashes))
        texts = pa.array(items, pa.string())
        while len(open_):
            open_ = open_[hashes[at[open_]] == wanted[open_]]
            found = order[at[open_]]
            same = pc.equal(self.names.take(pa.array(found)), texts.take(pa.array(open_))).to_numpy(zero_copy_only=False).astype(bool)
            rows[open_[same]] = found[same]
            open_ = open_[~same]  # another item with this hash: the next one
            at[open_] += 1
            open_ = open_[at[open_] < len(hashes)]
        return rows

    def row(self, k: int) -> np.ndarray:
        a, b = self.starts[k : k + 2]
        row = self.base.copy()
        row[self.langs[a:b]] += self.above[a:b]
        return row

    def __getitem__(self, item: str) -> np.ndarray:
        return self.row(int(self.find([item])[0]))

    def add(self, sums: np.ndarray, owner: np.ndarray, rows: np.ndarray, times: np.ndarray) -> None:
        """Adds the items' log frequencies, so often each, to the rows ``owner`` of ``sums``."""
        texts, languages = sums.shape
        sums += np.bincount(owner, times, texts)[:, None] * self.base
        lengths = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        into = np.repeat(owner * languages, lengths) + self.langs[at].astype(np.int64)
        sums += np.bincount(into, np.repeat(times, lengths) * self.above[at], sums.size).reshape(sums.shape)


class Model:
    """Log frequencies by language, for words and for n-grams."""

    def __init__(self, counted: pa.Table | list[tuple], evidence: int = 12):
        """``counted``: lang, item, n; each pair once, n-grams behind a tab."""
        if isinstance(counted, list):
            kinds = [("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())]
            counted = pa.table([pa.array(c, k) for c, (_, k) in zip(list(zip(*counted)) or [[]] * 3, kinds)], names=[n for n, _ in kinds])
        names = pc.unique(counted.column("lang")).sort()
        self.languages, self.evidence, self.key = names.to_pylist(), evidence, uuid.uuid4().hex
        item = counted.column("item")
        coded = pa.table({"lang": pc.index_in(counted.column("lang"), names), "item": item, "n": counted.column("n")})
        is_gram = pc.starts_with(item, "\t")
        self.words = Vocabulary(coded.filter(pc.invert(is_gram)), len(names))
        tabbed = coded.filter(is_gram)
        self.grams = Vocabulary(tabbed.set_column(1, "item", pc.utf8_slice_codeunits(tabbed.column("item"), 1)), len(names))

    def backed_off(self, words: list[str]) -> list[list[int]]:
        """The known n-grams that stand for each unseen word: its longest ones."""
        tried = [(k, n, g) for k, word in enumerate(words) for n in range(LONGEST, 0, -1) for g in grams(word, n)]
        out: list[list[int]] = [[] for _ in words]
        longest = [0] * len(words)
        for (k, n, _), row in zip(tried, self.grams.find([g for _, _, g in tried]).tolist()):
            if row >= 0 and longest[k] in (0, n):
                longest[k] = n
                out[k].append(row)
        return out

    def of_word(self, word: str) -> np.ndarray | None:
        """A word's log frequency by language; None for a word of which not even a letter is known."""
        (row,) = self.words.find([word])
        if row >= 0:
            return self.words.row(int(row))
        (known,) = self.backed_off([word])
        return np.mean([self.grams.row(k) for k in known], axis=0) if known else None

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The languages and scores of a list of texts; each word of the list is looked up once."""
        count, languages = len(texts), len(self.languages)
        if not languages:
            return ["und"] * count, [0.0] * count
        if count > 1 and count * languages > 1 << 22:
            halves = [self.predict_all(part) for part in (texts[: count // 2], texts[count // 2 :])]
            return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]
        counted = [Counter(WORD(text.lower())) if text else Counter() for text in texts]
        words = list(set().union(*counted))
        places = self.words.find(words).tolist()
        place = dict(zip(words, places))
        unseen = [w for w, p in zip(words, places) if p < 0]
        instead = dict(zip(unseen, self.backed_off(unseen)))
        sizes, rows, times = np.array([len(c) for c in counted], np.int64), [], []
        gram_rows, gram_sizes, gram_owner, gram_times = [], [], [], []
        for t, counts in enumerate(counted):
            found = list(map(place.__getitem__, counts))
            rows += found
            times += counts.values()
            if -1 in found:
                for (word, n), row in zip(counts.items(), found):
                    if row < 0 and (known := instead[word]):
                        gram_rows += known
                        gram_sizes.append(len(known))
                        gram_owner.append(t)
                        gram_times.append(n)
        rows, times, owner = np.array(rows, np.int64), np.array(times, float), np.repeat(np.arange(count), sizes)
        known = rows >= 0
        rows, times, owner = rows[known], times[known], owner[known]
        gram_rows, gram_sizes, gram_owner, gram_times = (np.array(x, np.int64) for x in (gram_rows, gram_sizes, gram_owner, gram_times))
        sums = np.zeros((count, languages))
        self.words.add(sums, owner, rows, times)
        if len(gram_rows):
            self.grams.add(sums, np.repeat(gram_owner, gram_sizes), gram_rows, np.repeat(gram_times / gram_sizes, gram_sizes))
        total = np.bincount(owner, times, count) + np.bincount(gram_owner, gram_times, count)
        best = sums.argmax(1)
        gaps = (sums - sums[np.arange(count), best][:, None]) / np.maximum(total, 1)[:, None] * np.minimum(total, self.evidence)[:, None]
        scores = np.where(sizes > 0, 1 / np.exp(gaps).sum(1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist())], scores.tolist()

    def predict(self, text: str | None, of_word=None) -> tuple[str, float]:
        """The language and score of one text."""
        (lang,), (score,) = self.predict_all([text])
        return lang, score


def fit(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = 5_000, all_rows: int = 50_000
) -> Model:
    """A model of all words and n-grams of the sampled rows; see the module's text."""
    usable = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select("doc_id", lang_col, text_col)
    named = cut_lineage(usable.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n")))
    bound = min(sample_rows, max(all_rows // max(named.count(), 1), 200))
    chance = F.least(F.lit(bound) / F.col("_n"), F.lit(1.0)) * float(1 << 30)
    usable = usable.join(named, F.col(lang_col) == F.col("_lang")).where(
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < chance, F.lit(True))
    )
    return Model(count_rows(usable, lang_col, text_col).toArrow())  # what the sample holds


def _shared(df: DataFrame, model: Model):
    """The model as each process reads it: once, in place of what earlier work has left there."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return lambda: resident(f"language-{sent.value.key}", lambda: sent.value)


def predict_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    shared = _shared(df, model)

    def make():
        known = shared()
        return lambda keys, texts: (keys, *known.predict_all(texts))

    return map_pieces(df, [id_col, text_col], "doc_id long, lang_pred string, score double", make)


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language, at that score or higher."""

    shared = _shared(df, model)

    def make():
        known = shared()

        def identified(texts):
            return [lang != "und" and score >= least for lang, score in zip(*known.predict_all(texts))]

        return identified

    return keep_pieces(df, text_col, make)
