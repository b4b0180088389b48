"""Toxicity of disguised text: a noisy channel is decoded with a character model, then the restored words are scored.

1. Character model. Counts of letter 3-grams and (hashed into a fixed table) 4-grams over the texts of all documents,
   added up inside each task before the shuffle. The tables have a fixed size, so the model can be broadcast.
2. Decoding. A token with signs or digits among its letters, a letter three times in a row, or a run of single
   characters set apart becomes a lattice: signs that look like letters may be those letters, separators may vanish
   or end a word, long repetitions may shrink to one or two letters. Viterbi finds the likeliest path under the
   channel's costs and the character model. Plain words have one path and are left as they are.
3. Scoring. Features are the restored words and their beginnings of 3 to 6 letters, hashed. A feature's strength is
   its share of toxic texts among the texts of a labelled sample that have it; only features for which that share is
   surely above a half count. A logistic regression weighs three numbers of a text: the log odds of its strongest token,
   how many such tokens it has, and how dense they are. Texts without any get the rate of the rest.

The sample is bounded (``per_label`` distinct texts of each label, lowest hash first), the character model is not a
sample. Each sampled text stands for as many as its label has per sampled one, so shares, strengths and weights are those
of the labels' true mix whatever the sample's. Null and empty texts get the base rate. Null labels are no labels; of several labels of one document the
highest counts, and copies of a text count once. Rows with repeated or null ids are scored each by itself. Columns
other than the named ones are ignored. Empty tables give empty results; without labels every score is the base rate.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import Memo, resident
from tidemark.llm.text_map import keep_rows, map_rows
from tidemark.session import cut_lineage

# Signs that are written for letters.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'·•"
EDGES = ".,;:?!\"')]}([{»«…“”‘’"

GRAMS, FEATURES = 1 << 20, 1 << 18
TOKENS, KNOWN = 100_000, 1 << 18  # what a process remembers: twice so many tokens, so many log probabilities
SWAP, DROP, KEEP = 1.0, 0.7, 2.0  # costs in nats of a letter for a sign, of an ignored separator, of a sign that is no letter

SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){2,}(?!\S)")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
EDGE_RUN = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")


@lru_cache(1)
def symbols() -> np.ndarray:
    """A number from 1 to 63 for each letter's code point, 0 for all else: a to z have their own, other letters share."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % 37
    return table


def hashed(code):
    return (code * 0x9E3779B1 >> 8) & (GRAMS - 1)


def gram_counts(texts: list[str], into3: np.ndarray, into4: np.ndarray) -> None:
    """Adds the grams of the texts; what stands before a word's first letter is nothing."""
    data = symbols()[np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)]
    data = data[(data > 0) | np.append(True, data[:-1] > 0)].astype(np.int64)  # one 0 between words
    last = np.append(0, data[:-1])
    second = np.append([0, 0], data[:-2])[: len(data)] * (last > 0)
    third = np.append([0, 0, 0], data[:-3])[: len(data)] * (second > 0)
    three = second << 12 | last << 6 | data
    into3 += np.bincount(three, minlength=1 << 18)
    into4 += np.bincount(hashed(third << 18 | three), minlength=GRAMS)


def character_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts; 4-grams stand behind the 3-grams."""

    def run(batches):
        into3, into4 = np.zeros(1 << 18, np.int64), np.zeros(GRAMS, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(text)
                    size += len(text)
                if size > 1 << 20:
                    gram_counts(held, into3, into4)
                    held, size = [], 0
            if held:
                gram_counts(held, into3, into4)
        both = np.concatenate([into3, into4])
        found = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(both[found])], names=["gram", "n"])

    return df.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Log probabilities of a letter after three, backing off to two and one."""

    def __init__(self, counts3: np.ndarray, counts4: np.ndarray, strength: float = 5.0):
        self.three, self.four, self.strength = counts3, counts4, strength
        self.two = counts3.reshape(64, 4096).sum(0)
        self.one = self.two.reshape(64, 64).sum(0)
        self.context2 = counts3.reshape(4096, 64).sum(1)
        self.known: dict[int, float] = {}
        self.key = uuid.uuid4().hex  # what processes remember is kept apart by model

    @classmethod
    def of(cls, counts: DataFrame) -> CharacterModel:
        both = np.zeros((1 << 18) + GRAMS, np.int64)
        rows = counts.toPandas()  # at most as many rows as the fixed tables have places
        both[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        return cls(both[: 1 << 18].astype(np.float32), both[1 << 18 :].astype(np.float32))

    def log(self, history: int, symbol: int) -> float:
        """``history``: the last three symbols, six bits each."""
        key = history << 6 | symbol
        value = self.known.get(key)
        if value is None:
            k, pair = self.strength, history & 4095
            last = history & 63
            p = (float(self.one[symbol]) + 0.1) / (float(self.one.sum()) + 6.4)
            p = (float(self.two[last << 6 | symbol]) + k * p) / (float(self.two.reshape(64, 64)[last].sum()) + k)
            p = (float(self.three[pair << 6 | symbol]) + k * p) / (float(self.context2[pair]) + k)
            p = (float(self.four[hashed(key)]) + k * p) / (max(float(self.three[history]), float(self.four[hashed(key)])) + k)
            if len(self.known) >= KNOWN:
                self.known.clear()
            value = self.known[key] = math.log(p)
        return value


class Restorer:
    """Decodes disguised words."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.symbol = Memo(lambda c: int(symbols()[ord(c)]), 10_000)

    def lattice(self, text: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each place what it may say, with its cost; a blank ends a word."""
        places, i = [], 0
        while i < len(text):
            c, run = text[i], 1
            while i + run < len(text) and text[i + run] == c:
                run += 1
            if c.isalpha():
                if run >= 3 and not spaced:
                    places += [[(c, 0.0)], [(c, DROP), ("", 0.0)]]
                else:
                    places += [[(c, 0.0)]] * run
            elif c in LOOKS_LIKE:
                letters = [(x, SWAP) for x in LOOKS_LIKE[c]]
                places += [[*letters, (" ", KEEP)]] * min(run, 2) if run >= 3 else [[*letters, (" ", KEEP)]] * run
            elif c in SEPARATORS or (spaced and c.isspace()):
                places.append([("", DROP), (" ", DROP)])
            else:
                places.append([(" ", 0.0)])
            i += run
        return places

    def decode(self, text: str, spaced: bool = False) -> str:
        """The likeliest reading: Viterbi over the last three symbols."""
        log, symbol = self.model.log, self.symbol
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for options in [*self.lattice(text.lower(), spaced), [(" ", 0.0)]]:
            after: dict[int, tuple[float, tuple]] = {}
            for history, (score, path) in best.items():
                for said, cost in options:
                    if not said:
                        state, value, way = history, score - cost, path
                    elif said == " ":
                        ended = history & 63 == 0
                        state = 0
                        value = score - cost + (0.0 if ended else log(history, 0))
                        way = path if ended else (path, " ")
                    else:
                        s = symbol[said]
                        state = (history << 6 | s) & 0x3FFFF if history & 63 else s
                        value, way = score - cost + log(history, s), (path, said)
                    if state not in after or value > after[state][0]:
                        after[state] = value, way
            best = after
        _, path = max(best.values(), key=lambda x: x[0])
        out = []
        while path:
            path, said = path
            out.append(said)
        return "".join(reversed(out)).strip()

    def token(self, token: str) -> str:
        """A token without its outer signs, decoded if it is not a plain word."""
        core = EDGE_RUN.sub("", EDGE_RUN.sub("", token).strip(EDGES)).strip(EDGES)
        if core.isalpha() and not TRIPLE.search(core):
            return core.lower()
        if not any(c.isalpha() for c in core):
            return ""
        return self.decode(core)

    def text(self, text: str) -> str:
        """The whole text with its disguised words restored; white space stays."""
        parts, at = [], 0
        for found in SPACED.finditer(text):
            parts += [self._plain(text[at : found.start()]), self.decode(found[0], spaced=True)]
            at = found.end()
        return "".join([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.token(m[0]) if self.disguised(m[0]) else m[0], text)

    def disguised(self, token: str) -> bool:
        core = EDGE_RUN.sub("", EDGE_RUN.sub("", token).strip(EDGES)).strip(EDGES)
        return any(c.isalpha() for c in core) and (not core.isalpha() or bool(TRIPLE.search(core)))

    def tokens(self, text: str) -> Counter:
        """The text's tokens and how often each occurs; a spaced run gives its reading, word by word and as one word."""
        found = Counter(text.split())
        for run in SPACED.finditer(text):
            found.update(self.decode(run[0], spaced=True).split())
            found["".join(c for c in run[0] if c.isalnum())] += 1
        return found


def features(word: str) -> list[int]:
    """Hashed features of a restored word: itself and its beginnings."""
    names = [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) >= n)]
    return [zlib.crc32(n.encode()) & (FEATURES - 1) for n in names]


class _Worker:
    """What a process keeps between its tasks: the features of a token, or the strength of its strongest feature."""

    def __init__(self, model: CharacterModel, strengths: dict[int, float] | None):
        self.restorer = Restorer(model)
        of = lambda t: {f for w in self.restorer.token(t).split() for f in features(w)}
        if strengths is None:
            self.of_token = Memo(of, TOKENS // 2)
        else:
            self.of_token = Memo(lambda t: max((strengths[f] for f in of(t) if f in strengths), default=0.0), TOKENS)

    def stats(self, text: str) -> tuple[float, float, float]:
        """Evidence in a text: log odds of the strongest token, how many there are, and how dense they are."""
        tokens = self.restorer.tokens(text)
        hits = [(s, n) for s, n in ((self.of_token[t], n) for t, n in tokens.items()) if s]
        if not hits:
            return 0.0, 0.0, 0.0
        top = max(s for s, _ in hits)
        return math.log(top / (1 - top)), math.log1p(sum(n for _, n in hits)), math.log1p(100 * sum(s * n for s, n in hits) / tokens.total())


def _worker(key: str, model: CharacterModel, strengths: dict[int, float] | None) -> _Worker:
    return resident(key, lambda: _Worker(model, strengths))


def labelled_texts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(_hash, toxic, doc_id): the distinct labelled texts."""
    marked = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    texts = df.select(F.col(id_col).alias("_id"), F.xxhash64("text").alias("_hash")).where("_id IS NOT NULL")
    return texts.join(marked, "_id").groupBy("_hash").agg(F.max("toxic").alias("toxic"), F.min("_id").alias("doc_id"))


def labelled_sample(df: DataFrame, labels: DataFrame, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, toxic): at most ``per_label`` distinct texts of each label, those of the lowest hash."""
    return sample_of(labelled_texts(df, labels, id_col), per_label)


def sample_of(once: DataFrame, per_label: int) -> DataFrame:
    order = [F.xxhash64("_hash"), F.col("doc_id")]
    picked = [once.where(F.col("toxic") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    return picked[0].unionByName(picked[1]).select("doc_id", "toxic")


def label_weights(once: DataFrame, per_label: int) -> tuple[float, float]:
    """How many distinct texts a sampled one stands for, of label 0 and of label 1."""
    counts = {r["toxic"]: r["n"] for r in once.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return tuple(max(counts.get(v, 0) / per_label, 1.0) for v in (0, 1))


class Classifier:
    """Strengths of features and the weights of what a text shows of them."""

    def __init__(self, strengths: dict[int, float], weights: np.ndarray):
        self.strengths, self.weights = strengths, [float(w) for w in weights]
        self.key = uuid.uuid4().hex

    def score(self, stats: tuple[float, float, float]) -> float:
        x = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], stats))
        return 1 / (1 + math.exp(-max(min(x, 30.0), -30.0)))


def fit_strengths(
    rows: DataFrame, model: CharacterModel, least: float, stands_for: tuple[float, float] = (1.0, 1.0)
) -> dict[int, float]:
    """The share of toxic texts among those with a feature, of the features that mark toxic texts.

    ``stands_for``: see ``label_weights``. That a feature marks toxic texts at all is tested on what was counted, its share on the true mix.
    """
    key = f"fit-{model.key}"

    def run(batches):
        worker = _worker(key, model, None)
        counts = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for t in worker.restorer.tokens(text or "") for f in worker.of_token[t]} - {0}
                counts[int(toxic > 0), [0, *found]] += 1  # place 0 counts the texts
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts.ravel()[place])], names=["place", "n"])

    counted = rows.select("text", "toxic").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    table = np.zeros(2 * FEATURES)
    found = counted.toPandas()  # a place for each label and hashed feature at most
    table[found["place"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    clean, toxic = table.reshape(2, FEATURES)
    n0, n1 = max(clean[0], 1.0), max(toxic[0], 1.0)
    share = (clean + toxic) / (n0 + n1)
    gap = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    of0, of1 = stands_for
    whole = np.maximum(of1 * toxic + of0 * clean, 1.0)
    n = np.maximum(whole**2 / np.maximum(of1**2 * toxic + of0**2 * clean, 1e-12), 1.0)  # as many texts of equal weight; all if weights are equal
    p = of1 * toxic / whole
    surely = (p + 2 / n - 2 * np.sqrt(p * (1 - p) / n + 1 / n**2)) / (1 + 4 / n)  # Wilson's bound at two deviations
    chosen = np.flatnonzero((gap > 4) & (surely > least))
    return {int(f): float((of1 * toxic[f] + 0.25) / (whole[f] + 0.5)) for f in chosen if f}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, stands_for: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Logistic regression by Newton's method; few columns, a bounded number of rows, weighted by ``label_weights``."""
    x = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(x.shape[1])
    times = np.where(y > 0, stands_for[1], stands_for[0])
    times = times / times.mean()
    penalty = ridge * np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (times * (y - p)) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(df: DataFrame, labels: DataFrame, model: CharacterModel, per_label: int = 8000, least: float = 0.5) -> Classifier:
    """A classifier from the labelled sample; see the module's text."""
    once = cut_lineage(labelled_texts(df, labels))
    stands_for = label_weights(once, per_label)
    sample = sample_of(once, per_label).withColumnRenamed("doc_id", "_id")
    rows = df.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # 2 * per_label ids at most
    rows = cut_lineage(rows.select("text", "toxic"))
    strengths = fit_strengths(rows, model, least, stands_for)
    key = f"weigh-{uuid.uuid4().hex}"

    def make():
        worker = _worker(key, model, strengths)
        return lambda text, toxic: (*worker.stats(text or ""), int(toxic > 0))

    seen = map_rows(rows, ["text", "toxic"], "a double, b double, c double, y int", make).toPandas()  # as many rows as the sample
    if seen["y"].nunique() < 2:
        return Classifier(strengths, np.array([-3.0, 0.0, 0.0, 0.0]))
    return Classifier(strengths, fit_weights(seen[["a", "b", "c"]].to_numpy(float), seen["y"].to_numpy(float), stands_for=stands_for))


def score_texts(df: DataFrame, model: CharacterModel, classifier: Classifier) -> DataFrame:
    """doc_id, score and predicted of every row; see the module's text."""
    key = f"score-{model.key}-{classifier.key}"

    def make():
        worker = _worker(key, model, classifier.strengths)

        def row(doc, text):
            score = classifier.score(worker.stats(text or ""))
            return doc, score, int(score >= 0.5)

        return row

    return map_rows(df, ["doc_id", "text"], "doc_id long, score double, predicted int", make)


def keep_clean(df: DataFrame, model: CharacterModel, classifier: Classifier) -> DataFrame:
    """The rows, with all their columns, whose text is not predicted to be toxic."""
    key = f"score-{model.key}-{classifier.key}"

    def make():
        worker = _worker(key, model, classifier.strengths)
        return lambda text: classifier.score(worker.stats(text or "")) < 0.5

    return keep_rows(df, "text", make)


def restore_texts(df: DataFrame, model: CharacterModel) -> DataFrame:
    """doc_id and the text with its disguised words restored; null texts stay null."""
    key = f"restore-{model.key}"

    def make():
        restorer = _worker(key, model, {}).restorer
        return lambda doc, text: (doc, None if text is None else restorer.text(text))

    return map_rows(df, ["doc_id", "text"], "doc_id long, text string", make)
