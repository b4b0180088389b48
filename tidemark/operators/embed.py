"""Document vectors: weighted term vectors, token-vector means, trained and pretrained vectors.

An embedder turns cleaned documents ``(patent, year, contents)`` and the windows of a run into
vectors keyed by ``(model, window, patent)``. The window is a group key of one job: texts are
tokenised once, and document frequencies of a window are sums of the frequencies of its years.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import text as T
from tidemark.functions.vectors import REST, WHOLE, exact_sum, inverse_weight, logistic_weight, rare_token_weight
from tidemark.operators import blocks as B
from tidemark.operators.packed import Rows, packer, runs
from tidemark.operators.windows import window_years
from tidemark.session import cut_lineage


def unit_rows(rows: DataFrame, keys: list[str], norm: str) -> DataFrame:
    """Divide ``w`` by the document's norm; a zero norm leaves it as it is.

    The window is one document's terms, so its rows never exceed the vocabulary of a document. Norms are exact sums, so
    equal documents get equal vectors, to the last bit, in every run.
    """
    doc = Window.partitionBy(*keys)
    if norm == "l1":
        length = exact_sum(F.abs("w"), doc)
    else:
        length = F.sqrt(exact_sum(F.col("w") * F.col("w"), doc))
    return rows.withColumn("w", F.col("w") / F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(1.0)))


def window_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("window").agg(F.count(F.lit(1)).alias("n_docs"))


@dataclass
class Corpus:
    """Documents with the windows they belong to.

    ``members(window, patent, year)`` is the usual assignment by year, or a sample of it; with
    ``by_year`` per-window term statistics are rolled up from years instead of counted per copy.
    """

    docs: DataFrame
    windows: DataFrame
    members: DataFrame
    by_year: bool = True

    @classmethod
    def of(cls, docs: DataFrame, windows: DataFrame, members: DataFrame | None = None) -> "Corpus":
        if members is not None:
            return cls(docs, windows, members, by_year=False)
        placed = docs.select("patent", "year").join(window_years(windows), "year")
        return cls(docs, windows, placed.select("window", "patent", "year"))

    def own_docs(self) -> DataFrame:
        """The documents that any window lists: the others have no part in statistics or vectors."""
        if self.by_year:
            return self.docs.join(window_years(self.windows).select("year").distinct(), "year", "left_semi")
        return self.docs.join(self.members.select("patent").distinct(), "patent", "left_semi")

    def window_numbers(self) -> list[str]:
        """The names of the run's windows, a list as short as the run specification; their places number them."""
        return sorted(r["window"] for r in self.windows.select("window").distinct().collect())

    def term_blocks(self, docs: DataFrame, copies: int = 1) -> tuple[DataFrame, DataFrame]:
        """``counted_docs`` in blocks of about BLOCK terms of one year (or sampled window), and the terms that each block holds.

        The second table ``(_at, block, order, term, window, number, df, total)`` has a row for each distinct term of a block and
        window, with the documents that hold the term in the whole window, and its total frequency there. It is dealt by term
        once, and weights go back to the blocks along it; the rows of a document stay one row throughout, and travel packed.
        ``copies`` is the number of weights, or the length of the vector, that a term brings to a block.
        """
        years = window_years(self.windows)
        numbers = docs.sparkSession.createDataFrame(list(enumerate(self.window_numbers())), "number int, window string")
        if self.by_year:
            years = years.join(F.broadcast(numbers), "window").withColumnRenamed("year", "_at")  # as small as the run specification
            copies *= self.overlap()
            placed = docs.withColumn("_at", F.col("year"))
        else:
            years = numbers.withColumn("_at", F.col("window"))
            placed = docs.drop("year").join(self.members, "patent").withColumn("_at", F.col("window")).drop("window")
        placed = placed.where(F.size("counted") > 0)
        # one number for each year or window
        blocks = placed.groupBy("_at").agg(F.ceil(F.sum(F.size("counted")) / max(BLOCK // copies, SMALLEST)).alias("_blocks"))
        placed = placed.join(F.broadcast(blocks), "_at").withColumn("block", F.pmod(F.xxhash64("patent"), F.col("_blocks")).cast("int")).drop("_blocks")
        at = placed.schema["_at"].dataType.simpleString()
        packages = pack_docs(placed).repartition("_at", "block").sortWithinPartitions("_at", "block")
        held = packages.mapInArrow(block_counts, f"_at {at}, block int, order int, term string, df long, total long")
        # all rows of a term are together: a row for each block that holds it
        held = held.repartition("term").join(F.broadcast(years), "_at")
        whole = Window.partitionBy("term", "order", "number")
        return placed, held.withColumn("df", F.sum("df").over(whole)).withColumn("total", F.sum("total").over(whole))

    def overlap(self) -> int:
        """The most windows that share a year."""
        if not self.by_year:
            return 1
        return window_years(self.windows).groupBy("year").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1

    def weigh(
        self, placed: DataFrame, weights: DataFrame, schema: str, make: Callable, models: int = 1, vectors: DataFrame | None = None,
    ) -> DataFrame:
        """What ``make`` gives for the documents of each block and the weights of its terms.

        ``weights`` has the rows of ``term_blocks`` with a weight ``x`` by the number ``m`` of a model; the weights of a term in all windows of a year
        are one array. A task sees the terms of a block first, then its documents. ``vectors(term, vector)``, if given, go with the weights.
        """
        keys = ["_at", "block", "order", "term"]
        code = (F.col("number") * models + F.col("m")).cast("int")
        if models * self.overlap() == 1:
            at = weights.select(*keys, F.array(code).alias("codes"), F.array("x").alias("xs"))
        else:
            at = weights.groupBy(*keys).agg(F.collect_list(F.struct(code.alias("code"), "x")).alias("w"))
            at = at.select(*keys, F.col("w.code").alias("codes"), F.col("w.x").alias("xs"))
        at = at.withColumn("vector", F.lit(None).cast("array<double>")) if vectors is None else at.join(vectors, "term")
        kinds = {f.name: f.dataType for f in placed.schema}
        term = F.struct("order", "term", "codes", "xs", F.col("vector").cast("array<double>").alias("vector"))
        # a few rows for each block, of about CHUNK terms: thousands of long rows pass to Python faster than millions
        chunk = F.pmod(F.xxhash64("term"), F.lit(max(BLOCK // CHUNK, 1))).alias("chunk")
        terms = at.select("_at", "block", F.lit(0).alias("kind"), chunk, term.alias("t"))
        docs = pack_docs(placed).select("_at", "block", F.lit(1).alias("kind"), F.lit(0).alias("chunk"), "package")
        both = terms.unionByName(docs, allowMissingColumns=True).repartition("_at", "block")
        both = both.groupBy("_at", "block", "kind", "chunk").agg(F.collect_list("t").alias("t"), F.collect_list("package").alias("packages"))
        both = both.sortWithinPartitions("_at", "block", "kind")
        kernel = block_kernel(make, self.window_numbers(), models)
        return both.mapInArrow(kernel, schema.format(patent=kinds["patent"].simpleString(), year=kinds["year"].simpleString()))


# Terms of the documents of a block, of a block whose terms bring many weights, and numbers that a task fills at a time.
BLOCK, SMALLEST, SLICE, CHUNK = 1 << 20, 1 << 14, 1 << 21, 1 << 14
TERM_ROWS = "model string, window string, patent {patent}, year {year}, v array<struct<term: string, w: double>>"


def pack_docs(placed: DataFrame) -> DataFrame:
    """``(_at, block, package)`` of the documents of ``Corpus.term_blocks``."""
    rows = placed.select("_at", "block", "patent", "year", "counted")
    return rows.mapInArrow(packer(["_at", "block"], "counted"), f"_at {rows.schema['_at'].dataType.simpleString()}, block int, package binary")


def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each block, by order, with the documents that hold them and their total frequency."""

    def counts(kind: pa.DataType, at, block: int, rows: Rows) -> pa.RecordBatch:
        order, tf = rows.fields["order"], rows.fields["tf"]
        code = rows.codes.astype(np.int64) * (int(order.max(initial=0)) + 1) + order
        code, number, df = np.unique(code, return_inverse=True, return_counts=True)
        total = np.zeros(len(code), dtype=np.int64)
        np.add.at(total, number, tf)
        term, order = np.divmod(code, int(order.max(initial=0)) + 1)
        columns = [pa.array([at] * len(code), kind), pa.array(np.full(len(code), block), pa.int32()), pa.array(order, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [*columns, rows.names.take(pa.array(term)), pa.array(df, pa.int64()), pa.array(total)],
            names=["_at", "block", "order", "term", "df", "total"],
        )

    current, held = None, []
    for key, part in runs(batches, ["_at", "block"]):
        key = (part.column("_at").type, *key)
        if key != current and held:
            yield counts(*current, Rows.concat(held))
            held = []
        current = key
        held += [Rows.unpack(p.as_py()) for p in part.column("package")]
    if held:
        yield counts(*current, Rows.concat(held))


class BlockTerms:
    """The terms of a block: by order for look-ups, with weights by (window, m), and vectors if there are any."""

    def __init__(self, parts: list[pa.RecordBatch], windows: list[str], models: int):
        entries = pa.concat_arrays([p.column("t").flatten() for p in parts])
        column = entries.field
        order, terms = column("order").to_numpy(zero_copy_only=False), column("term")
        self.n = len(terms)
        self.by_order = {o: (terms.filter(pa.array(order == o)), np.flatnonzero(order == o)) for o in np.unique(order)}
        codes = column("codes")
        rows = np.repeat(np.arange(self.n), codes.value_lengths().to_numpy())
        codes, x = codes.flatten().to_numpy(), column("xs").flatten().to_numpy()
        by_code = np.argsort(codes, kind="stable")
        groups = np.split(by_code, np.flatnonzero(np.diff(codes[by_code])) + 1)
        self.groups = [(windows[codes[g[0]] // models], int(codes[g[0]] % models), rows[g], x[g]) for g in groups]
        vectors = column("vector")
        self.vectors = None if vectors.null_count else vectors.flatten().to_numpy().reshape(self.n, -1)

    def places(self, order: np.ndarray, names: pa.Array, codes: np.ndarray) -> np.ndarray:
        """The number of each entry's term in the block, -1 for terms without a weight."""
        out = np.full(len(codes), -1, dtype=np.int64)
        for o, (known, numbers) in self.by_order.items():
            found = pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            found = np.where(found >= 0, numbers[found], -1)
            rows = np.flatnonzero(order == o)
            out[rows] = found[codes[rows]]
        return out


def block_kernel(make: Callable, windows: list[str], models: int) -> Callable:
    """Streams the blocks of a task: ``make(terms, docs, tf, entry terms, places, document numbers)`` for a slice of documents."""

    def slices(terms: BlockTerms, docs: Rows) -> Iterator[pa.RecordBatch]:
        width = 1 if terms.vectors is None else terms.vectors.shape[1]
        step = np.cumsum(docs.lens) // max(SLICE // width, 1)
        for rows in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(step)) + 1):
            part = docs.take(rows)
            places = terms.places(part.fields["order"], part.names, part.codes)
            number = np.repeat(np.arange(len(rows)), part.lens)
            yield from make(terms, part.own, part.fields["tf"], part.names.take(pa.array(part.codes)), places, number)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, terms = None, [], None
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("_at", "block", "kind")])
            start = 0
            for (*key, kind), run in groupby(keys):
                part = batch.slice(start, sum(1 for _ in run))
                start += len(part)
                if kind == 0:
                    parts, current = parts + [part] if key == current else [part], key
                    terms = None
                elif key == current:  # else no term of the block has a weight
                    terms = terms or BlockTerms(parts, windows, models)
                    for package in part.column("packages").flatten():
                        yield from slices(terms, Rows.unpack(package.as_py()))

    return kernel


def exact_sums(values: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """``exact_sum`` by document: sums of whole numbers, the same in any order."""
    counts = np.bincount(number, minlength=n)
    ends = np.cumsum(counts)
    whole = np.floor(values * WHOLE)
    rest = np.floor((values * WHOLE - whole) * REST)

    def sums(part: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(part.astype(np.int64))])
        return running[ends] - running[ends - counts]

    return sums(whole) / WHOLE + sums(rest) / (WHOLE * REST)


def term_vectors(
    corpus: Corpus, placed: DataFrame, weights: DataFrame, models: list[tuple[str, str | None, bool]]
) -> DataFrame:
    """``(model, window, patent, year, v)``: one row of (term, w) per document, of ``models`` (name, norm, sublinear) by number ``m``."""

    def make_rows(normed: bool) -> Callable:
        def make(terms, docs, tf, names, places, number):
            found = np.flatnonzero(places >= 0)
            for window, m, rows, x in terms.groups:
                name, norm, sublinear = models[m]
                values = np.full(terms.n, np.nan)
                values[rows] = x
                w = values[places[found]]
                kept = found[~np.isnan(w)]
                w = w[~np.isnan(w)] * (1.0 + np.log(tf[kept]) if sublinear else tf[kept])
                counts = np.bincount(number[kept], minlength=len(docs))
                if normed and norm is not None:
                    length = exact_sums(np.abs(w), number[kept], len(docs)) if norm == "l1" else np.sqrt(exact_sums(w * w, number[kept], len(docs)))
                    w = w / np.where(length == 0, 1.0, length)[number[kept]]
                has = counts > 0
                if not has.any():
                    continue
                entries = pa.StructArray.from_arrays([names.take(pa.array(kept)), pa.array(w)], names=["term", "w"])
                v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[has])]), pa.int32()), entries)
                same = lambda text: pa.array([text] * int(has.sum()), pa.string())
                own = [docs.column(c).filter(pa.array(has)) for c in ("patent", "year")]
                yield pa.RecordBatch.from_arrays([same(name), same(window), *own, v], names=["model", "window", "patent", "year", "v"])

        return make

    # an id with rows of several years is one document of a window that has them all: its length is taken over them
    per_id = placed.groupBy("patent").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    several = per_id.where("a < b").select("patent") if corpus.by_year else None
    if several is None or several.isEmpty():
        return corpus.weigh(placed, weights, TERM_ROWS, make_rows(True), len(models))
    several = cut_lineage(several)
    once = corpus.weigh(placed.join(several, "patent", "left_anti"), weights, TERM_ROWS, make_rows(True), len(models))
    raw = long_rows(corpus.weigh(placed.join(several, "patent", "left_semi"), weights, TERM_ROWS, make_rows(False), len(models)))
    parts = [once]
    for kind in {norm for _, norm, _ in models}:
        rows = raw.where(F.col("model").isin(*[name for name, norm, _ in models if norm == kind]))
        rows = rows if kind is None else unit_rows(rows, ["model", "window", "patent"], kind)
        parts.append(rows.groupBy("model", "window", "patent", "year").agg(F.collect_list(F.struct("term", "w")).alias("v")))
    return reduce(DataFrame.unionByName, parts)


def long_rows(vectors: DataFrame) -> DataFrame:
    """``(model, window, patent, year, term, w)`` of rows of documents."""
    return vectors.select("model", "window", "patent", "year", F.inline("v"))


# --- TF-IDF --------------------------------------------------------------------------------------


def doc_freq(docs: DataFrame, tokens: Column) -> DataFrame:
    """G-11: number of documents that contain each token."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df")
    )


def term_totals(counts: DataFrame, group: list[str] = ()) -> DataFrame:
    """G-12: total frequency of each term, and the largest total of its group."""
    totals = counts.groupBy(*group, "term").agg(F.sum("tf").alias("total"))
    if not group:
        return totals.withColumn("max_total", totals.agg(F.max("total")).scalar())
    return totals.join(totals.groupBy(*group).agg(F.max("total").alias("max_total")), group)


def default_stop_words(spark: SparkSession, language: str = "english") -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    if language not in ("english",):
        raise ValueError(f"no stop words for {language!r}")
    return StopWordsRemover.loadDefaultStopWords(language)


@dataclass(frozen=True)
class Tfidf:
    """E-1: term frequency times smoothed inverse document frequency, per window.

    ``tokenizer`` maps the text column to an array of tokens (for stems that may count signs and single letters); the
    default takes words of two letters or more.
    """

    ngram_max: int = 1
    stop_words: str | tuple[str, ...] | None = "english"
    stem: bool = False
    norm: str | None = "l1"
    sublinear_tf: bool = False
    min_df: int = 3
    max_df: float = 1.0
    tokenizer: Callable[[Column], Column] | None = field(default=None, compare=False, repr=False)

    kind = "Tfidf"
    sparse = True
    search = {  # J-3: lists are choices, pairs with a type are ranges
        "ngram_max": [1, 2, 3],
        "stop_words": ["english", None],
        "stem": [True, False],
        "norm": ["l1", "l2", None],
        "sublinear_tf": [True, False],
        "min_df": ("int", 1, 9),
        "max_df": ("float", 0.2, 1.0),
    }

    def __post_init__(self):
        for name in ("norm", "stop_words"):
            if getattr(self, name) == "None":
                object.__setattr__(self, name, None)
        if isinstance(self.stop_words, str) and self.stop_words.startswith("words:"):
            object.__setattr__(self, "stop_words", tuple(self.stop_words[6:].split(",")))
        if self.norm not in ("l1", "l2", None):
            raise ValueError(f"unknown norm {self.norm!r}")

    def settings(self) -> dict:
        out = asdict(self)
        del out["tokenizer"]
        out["norm"], out["stop_words"] = str(self.norm), str(self.stop_words)
        if isinstance(self.stop_words, tuple):
            out["stop_words"] = "words:" + ",".join(self.stop_words)
        return out

    def variant(self) -> tuple:
        """What decides the terms of a document, apart from the longest n-gram."""
        return (self.stop_words, self.stem, self.tokenizer or T.word_tokens)

    def transform(self, corpus: Corpus, name: str, stems: DataFrame | None = None) -> DataFrame:
        return tfidf(corpus, {name: self}, stems)

    def rows(self, corpus: Corpus, name: str, stems: DataFrame | None = None) -> DataFrame:
        """The same vectors, one row of (term, w) per document."""
        return tfidf_rows(corpus, {name: self}, stems)


def variant_tokens(docs: DataFrame, variant: tuple, stems: DataFrame | None) -> DataFrame:
    """``(patent, year, tokens)`` after stop words and stems."""
    stop_words, stem, tokenizer = variant
    tokens = tokenizer(F.col("contents"))
    if isinstance(stop_words, str):
        stop_words = default_stop_words(docs.sparkSession, stop_words)
    out = docs.select("patent", "year", tokens.alias("tokens"))
    if stem:
        if stems is None:
            raise ValueError("stem=True needs a stems(token, stem) table")
        out = stem_tokens(out, stems)
    if stop_words:
        words = sorted(set(stop_words))
        out = out.withColumn("tokens", F.filter("tokens", lambda w: ~w.isin(*words)))
    return out


def stem_tokens(docs: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace tokens by stems, looking up the vocabulary of each document once."""
    vocabulary = docs.select("patent", F.explode(F.array_distinct("tokens")).alias("token"))
    changed = vocabulary.join(stems.where("stem <> token"), "token").groupBy("patent").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "stem"))).alias("_stems")
    )
    stemmed = F.transform("tokens", lambda t: F.coalesce(F.try_element_at("_stems", t), t))
    return docs.join(changed, "patent", "left").withColumn("tokens", stemmed).drop("_stems")


def counted_docs(tokens: DataFrame, ngram_max: int) -> DataFrame:
    """``(patent, year, counted)``: the n-grams of 1 to ``ngram_max`` tokens of each document with their counts, as (order, term, tf).

    Terms are counted within the row of their document and written once, a row per document: no term is shuffled
    to be counted. Only the rows of ids that occur more than once are added up across rows.
    """
    def counted(n: int) -> Column:
        entry = lambda e: F.struct(F.lit(n).alias("order"), e["term"].alias("term"), e["tf"].alias("tf"))
        return F.transform(T.counted(T.ngrams(F.col("tokens"), n)), entry)

    keys = ["patent", "year"]
    rows = cut_lineage(tokens.select(*keys, F.concat(*[counted(n) for n in range(1, ngram_max + 1)]).alias("counted")))
    repeated = rows.groupBy(F.col("patent").alias("_p"), F.col("year").alias("_y")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if repeated.isEmpty():
        return rows
    # null ids and years are keys like any others, as in a grouping
    same = F.col("patent").eqNullSafe(F.col("_p")) & F.col("year").eqNullSafe(F.col("_y"))
    added = rows.join(repeated, same, "left_semi").select(*keys, F.inline("counted"))
    added = added.groupBy(*keys, "order", "term").agg(F.sum("tf").alias("tf"))
    added = added.groupBy(*keys).agg(F.collect_list(F.struct("order", "term", "tf")).alias("counted"))
    return cut_lineage(rows.join(repeated, same, "left_anti").unionByName(added))


def term_counts(tokens: DataFrame, ngram_max: int) -> DataFrame:
    """``(patent, year, order, term, tf)`` of ``counted_docs``."""
    return counted_docs(tokens, ngram_max).select("patent", "year", F.inline("counted"))


def tfidf(
    corpus: Corpus, models: dict[str, Tfidf], stems: DataFrame | None = None
) -> DataFrame:
    """E-1 for any number of settings at once: ``(model, window, patent, year, term, w)``."""
    return long_rows(tfidf_rows(corpus, models, stems))


def tfidf_rows(corpus: Corpus, models: dict[str, Tfidf], stems: DataFrame | None = None) -> DataFrame:
    """E-1, one row ``(model, window, patent, year, v)`` per document, with ``v`` an array of (term, w).

    Settings that share stop words and stems share one tokenisation and one count; the settings
    themselves are rows of a small table, so a tuning sweep is one job and not a loop.
    """
    variants: dict[tuple, list[tuple[str, Tfidf]]] = {}
    for name, model in models.items():
        variants.setdefault(model.variant(), []).append((name, model))
    parts = []
    for variant, named in variants.items():
        longest = max(m.ngram_max for _, m in named)
        # tokenising is the costly part, and its counts are read for frequencies and for weights
        counts = counted_docs(variant_tokens(corpus.own_docs(), variant, stems), longest)
        parts.append(weigh_tfidf(corpus, counts, named))
    return reduce(DataFrame.unionByName, parts)


def with_settings(rows: DataFrame, named: list[tuple[str, Tfidf]]) -> DataFrame:
    """Copy each term row to the settings ``m`` that use n-grams of its order (a literal list)."""
    options = F.array(
        *[
            F.struct(
                F.lit(n).alias("m"), F.lit(m.ngram_max).alias("ngram_max"),
                F.lit(int(m.min_df)).alias("min_df"), F.lit(float(m.max_df)).alias("max_df"),
            )
            for n, (_, m) in enumerate(named)
        ]
    )
    fitting = F.filter(options, lambda s: s["ngram_max"] >= F.col("order"))
    return rows.select("*", F.inline(fitting)).drop("ngram_max")


def weigh_tfidf(corpus: Corpus, counts: DataFrame, named: list[tuple[str, Tfidf]]) -> DataFrame:
    placed, held = corpus.term_blocks(counts, len(named))
    stats = held.join(F.broadcast(window_sizes(corpus.members)), "window")  # one row for each window
    low = F.least(F.col("min_df"), F.col("n_docs"))
    high = F.greatest(low / F.col("n_docs"), F.col("max_df")) * F.col("n_docs")
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    kept = with_settings(stats, named).where((F.col("df") >= low) & (F.col("df") <= high))
    return term_vectors(corpus, placed, kept.withColumn("x", idf), [(name, m.norm, m.sublinear_tf) for name, m in named])


# --- weighted counts -----------------------------------------------------------------------------


@dataclass(frozen=True)
class WeightedCounts:
    """E-2: white-space tokens weighted by their total frequency in the window, unit length."""

    method: str = "sigmoid"

    kind = "WeightedCounts"
    sparse = True
    search = {"method": ["prop", "sigmoid"]}

    def __post_init__(self):
        if self.method not in ("prop", "sigmoid"):
            raise ValueError(f"unknown method {self.method!r}")

    def settings(self) -> dict:
        return asdict(self)

    def transform(self, corpus: Corpus, name: str) -> DataFrame:
        return long_rows(self.rows(corpus, name))

    def rows(self, corpus: Corpus, name: str) -> DataFrame:
        """The same vectors, one row of (term, w) per document."""
        return counts_rows(corpus, {name: self})

    def weight(self) -> Column:
        return inverse_weight(F.col("total")) if self.method == "prop" else logistic_weight(F.col("total"), F.col("max_total"))


def counts_rows(corpus: Corpus, models: dict[str, WeightedCounts]) -> DataFrame:
    """E-2 for any number of settings at once, one row ``(model, window, patent, year, v)`` per document: words are counted once."""
    tokens = corpus.own_docs().select("patent", "year", T.split_words(F.col("contents")).alias("tokens"))
    placed, held = corpus.term_blocks(counted_docs(tokens, 1), len(models))
    if any(m.method == "sigmoid" for m in models.values()):
        held = cut_lineage(held)  # read for the largest totals and for the weights
        held = held.join(F.broadcast(held.groupBy("window").agg(F.max("total").alias("max_total"))), "window")
    weights = [F.struct(F.lit(n).alias("m"), m.weight().alias("x")) for n, m in enumerate(models.values())]
    return term_vectors(corpus, placed, held.select("*", F.inline(F.array(*weights))), [(name, "l2", False) for name in models])


# --- rare-weighted token vectors -----------------------------------------------------------------


@dataclass(frozen=True)
class TokenVectorMean:
    """E-3: mean of token vectors, rare tokens first, without the common direction of the window.

    ``token_vectors(token, vector)`` is a table; tokens are white-space words unless ``tokenizer``
    maps the text column to an array of tokens. Only vectors of ``vector_size`` are used; a table of several
    vocabularies has a column ``vocab_size``, by which they are told apart.
    """

    vector_size: int = 300
    vocab_size: int = 200_000
    remove_common: bool = True
    token_vectors: DataFrame | None = field(default=None, compare=False, repr=False)
    tokenizer: Callable[[Column], Column] = field(default=T.split_words, compare=False, repr=False)

    kind = "TokenVectorMean"
    sparse = False
    search = {
        "vector_size": [25, 50, 100, 200, 300],
        "vocab_size": [1000, 3000, 5000, 10000, 25000, 50000, 100000, 200000],
    }

    def settings(self) -> dict:
        return {"vector_size": self.vector_size, "vocab_size": self.vocab_size}

    def transform(self, corpus: Corpus, name: str) -> DataFrame:
        if self.token_vectors is None:
            raise ValueError("a token_vectors(token, vector) table is needed")
        tokens = corpus.own_docs().select("patent", "year", self.tokenizer(F.col("contents")).alias("tokens"))
        return self.weigh(corpus, counted_docs(tokens, 1), name)

    def own_vectors(self) -> DataFrame:
        """(term, vector) of this setting's size and vocabulary."""
        table = self.token_vectors.where(F.size("vector") == self.vector_size)
        if "vocab_size" in table.columns:
            table = table.where(F.col("vocab_size") == self.vocab_size)
        return table.select(F.col("token").alias("term"), "vector")

    def weigh(self, corpus: Corpus, counts: DataFrame, name: str) -> DataFrame:
        placed, held = corpus.term_blocks(counts, max(self.vector_size // 8, 1))
        factor = rare_token_weight(F.col("df"), F.col("n_docs"))
        factors = held.join(F.broadcast(window_sizes(corpus.members)), "window").withColumn("m", F.lit(0)).withColumn("x", factor)

        def make(terms, docs, tf, names, places, number):
            found = np.flatnonzero(places >= 0)
            for window, _, rows, x in terms.groups:
                values = np.full(terms.n, np.nan)
                values[rows] = x
                kept = found[~np.isnan(values[places[found]])]
                starts = np.flatnonzero(np.diff(number[kept], prepend=-1))
                if not len(starts):
                    continue
                weight = tf[kept] * values[places[kept]]
                sums = np.add.reduceat(terms.vectors[places[kept]] * weight[:, None], starts, axis=0)
                means = sums / np.add.reduceat(weight, starts)[:, None]
                same = lambda text: pa.array([text] * len(starts), pa.string())
                own = [docs.column(c).take(pa.array(number[kept][starts])) for c in ("patent", "year")]
                offsets = pa.array(np.arange(len(starts) + 1) * means.shape[1], pa.int32())
                embedding = pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [same(name), same(window), *own, embedding], names=["model", "window", "patent", "year", "embedding"]
                )

        schema = "model string, window string, patent {patent}, year {year}, embedding array<double>"
        # a document's rows are together, and so are their sums: a block's vectors meet its documents in one task
        out = corpus.weigh(placed, factors, schema, make, vectors=self.own_vectors())
        # the sums of the windows and the rows they are taken from: vectors are read twice, and made once
        return remove_common_direction(cut_lineage(out)) if self.remove_common else out


def remove_common_direction(embeddings: DataFrame, rows: int = B.ROWS) -> DataFrame:
    """Subtract from every vector its part along the leading right singular vector of its window.

    The direction is the leading eigenvector of the sum of outer products: a table of one short
    vector per window, however many documents the window has.
    """
    keys = ["model", "window"]
    blocks = B.gather_dense(B.with_block(embeddings, keys, rows), keys, "embedding")
    sums = B.sum_chunks(B.group_moments(blocks, keys), [*keys, "chunk"])
    packed = sums.groupBy(*keys).agg(B.join_chunks(F.col("chunk"), F.col("vals")).alias("moments"))

    @F.pandas_udf("array<double>")
    def leading(moments: pd.Series) -> pd.Series:
        def direction(m: np.ndarray) -> np.ndarray:
            d = round((-1 + (1 + 4 * (len(m) - 1)) ** 0.5) / 2)  # len = 1 + d + d*d
            values, vectors = np.linalg.eigh(np.reshape(m[1 + d :], (d, d)))
            return vectors[:, np.argmax(values)]

        return moments.map(lambda m: direction(np.asarray(m)))

    directions = packed.select(*keys, leading("moments").alias("_c"))
    joined = embeddings.join(directions, keys)
    along = F.aggregate(
        F.zip_with("embedding", "_c", lambda x, c: x * c), F.lit(0.0), lambda acc, x: acc + x
    )
    joined = joined.withColumn("_a", along)
    removed = F.zip_with("embedding", "_c", lambda x, c: x - F.col("_a") * c)
    return joined.withColumn("embedding", removed).select(*embeddings.columns)


# --- trained and pretrained vectors --------------------------------------------------------------


@dataclass(frozen=True)
class TrainedVectors:
    """E-4: vectors trained on the documents of each window (mean of trained word vectors).

    Training is Spark's own distributed Word2Vec, one fit per window: the windows are separate
    models, so their number, not the data, bounds this loop.
    """

    vector_size: int = 100
    min_count: int = 2
    epoch: int = 10
    seed: int = 1
    partitions: int | None = None  # the session's number of shuffle partitions

    kind = "TrainedVectors"
    sparse = False
    search = {
        "vector_size": ("int", 100, 300),
        "min_count": ("int", 1, 15),
        "epoch": ("int", 8, 15),
    }

    def settings(self) -> dict:
        return {"vector_size": self.vector_size, "min_count": self.min_count, "epoch": self.epoch}

    def transform(self, corpus: Corpus, name: str) -> DataFrame:
        from pyspark.ml.feature import Word2Vec
        from pyspark.ml.functions import vector_to_array

        names = [r["window"] for r in corpus.windows.select("window").collect()]  # the run's windows
        partitions = self.partitions or int(corpus.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = corpus.members.groupBy("patent").agg(F.collect_set("window").alias("_windows"))
        # words are found once, and read for the vocabulary, the training and the vectors of every window
        tokens = cut_lineage(
            corpus.docs.join(held, "patent").select("patent", "year", "_windows", T.word_tokens(F.col("contents")).alias("tokens"))
        )
        parts = []
        for window in names:
            docs = tokens.where(F.array_contains("_windows", window)).select("patent", "year", "tokens")
            if docs.isEmpty():
                continue
            model = Word2Vec(
                vectorSize=self.vector_size, minCount=self.min_count, maxIter=self.epoch, seed=self.seed,
                numPartitions=partitions, inputCol="tokens", outputCol="vector",
            ).fit(docs)
            vectors = model.transform(docs).select(
                F.lit(name).alias("model"), F.lit(window).alias("window"), "patent", "year",
                vector_to_array("vector").alias("embedding"),
            )
            # written at once, so that the driver holds the words of one window and not of all
            parts.append(cut_lineage(vectors))
            del model, vectors
        if not parts:
            raise ValueError("no documents in any window")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def hashing_encoder(dim: int = 64) -> Callable[[str], Callable[[list[str]], np.ndarray]]:
    """A small stand-in for encoders: signed word counts, placed by the md5 of the encoder's name and the word. It knows
    the names of ``PretrainedEncoder.search`` only."""

    def load(name: str) -> Callable[[list[str]], np.ndarray]:
        from functools import lru_cache
        from hashlib import md5

        if name not in PretrainedEncoder.search["pretrained_model"]:
            raise ValueError(f"there is no encoder {name!r}")

        @lru_cache(100_000)
        def place(word: str) -> tuple[int, float]:
            h = int(md5(f"{name}:{word}".encode()).hexdigest()[:8], 16)
            return h % dim, 1.0 if (h >> 16) & 1 else -1.0

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts):
                for word in text.lower().split():
                    k, sign = place(word)
                    row[k] += sign
            return out

        return encode

    return load


@dataclass(frozen=True)
class PretrainedEncoder:
    """E-5, C-14: a plug-in encoder, loaded once per Python worker; documents are encoded once.

    ``loader`` takes the model's name and returns its encode function (list of texts to matrix); it fails for a name
    that it does not know. There is no default.
    """

    pretrained_model: str = "prithivida/bert-for-patents-64d"
    loader: Callable[[str], Callable] | None = field(default=None, compare=False, repr=False)

    kind = "PretrainedEncoder"
    sparse = False
    pretrained = True
    search = {  # fixed values: the names of the public models a run may choose from
        "pretrained_model": [
            "prithivida/bert-for-patents-64d",
            "anferico/bert-for-patents",
            "AI-Growth-Lab/PatentSBERTa",
        ],
    }

    def settings(self) -> dict:
        return {"pretrained_model": self.pretrained_model}

    def encode(self, docs: DataFrame) -> DataFrame:
        """``(patent, year, embedding)``: no shuffle, one pass over the texts."""
        if self.loader is None:
            raise ValueError(f"a loader for {self.pretrained_model!r} is needed")
        loader, model = self.loader, self.pretrained_model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = None
            for batch in batches:
                encode = encode or loader(model)
                if len(batch):
                    vectors = np.asarray(encode(list(batch["contents"])), dtype=float)
                    yield batch[["patent", "year"]].assign(embedding=list(vectors))

        return docs.select("patent", "year", "contents").mapInPandas(
            run, "patent long, year int, embedding array<double>"
        )

    def encode_new(self, docs: DataFrame, stored: DataFrame) -> DataFrame:
        """Vectors of all documents, encoding only those whose id is not in ``stored``."""
        new = docs.join(stored.select("patent"), "patent", "left_anti")
        old = stored.join(docs.select("patent"), "patent", "left_semi")
        return old.select("patent", "year", "embedding").unionByName(self.encode(new))

    def transform(self, corpus: Corpus, name: str) -> DataFrame:
        encoded = self.encode(corpus.docs)
        return encoded.join(corpus.members.select("window", "patent"), "patent").select(
            F.lit(name).alias("model"), "window", "patent", "year", "embedding"
        )


EMBEDDERS = {
    cls.kind: cls for cls in (Tfidf, WeightedCounts, TokenVectorMean, TrainedVectors, PretrainedEncoder)
}


def create_model(kind: str, settings: dict):
    """A-15: an embedder by its stored class name and settings."""
    if kind not in EMBEDDERS:
        raise ValueError(f"no embedder is called {kind!r}")
    return EMBEDDERS[kind](**settings)
