"""Cleaning of scanned documents: filters, word repair, start-section removal, word lists."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import text as T
from tidemark.operators.windows import limit_per_year

# Fixed values of the start-section rule and of word re-joining.
CAPS_SHARE = 0.60
FIRST_WORDS = 1000
ALWAYS_WORDS = 10
ALWAYS_CHUNKS = 10
CHUNK_WORDS = 3
MIN_JOINED = 5


def has_year(year: Column) -> Column:
    return year.isNotNull() & (year != 0)


def filter_missing_year(docs: DataFrame, keep: bool = False) -> DataFrame:
    """B-1: year 0 or NULL means missing."""
    return docs if keep else docs.where(has_year(F.col("year")))


def filter_empty(docs: DataFrame, keep: bool = False) -> DataFrame:
    """B-2, on the raw text."""
    return docs if keep else docs.where(F.length("contents") > 0)


def filter_stats(
    docs: DataFrame, keep_missing_years: bool = False, keep_empty: bool = False
) -> DataFrame:
    """G-14: processed and skipped documents per file, and in total (``file`` NULL).

    Documents that come out of ``reassemble_words`` add the number of words that were put together.
    """
    no_year = ~has_year(F.col("year")) & F.lit(not keep_missing_years)
    empty = (F.length("contents") == 0) & F.lit(not keep_empty)
    return docs.rollup("file").agg(
        F.count_if(~no_year & ~empty).alias("processed"),
        F.count_if(~no_year & empty).alias("skipped_empty"),
        F.count_if(no_year).alias("skipped_no_year"),
        *[F.sum(c).alias(c) for c in ("words_reassembled",) if c in docs.columns],
    )


def remove_start_section(
    docs: DataFrame, share: float = CAPS_SHARE, remove_non_alpha: bool = False
) -> DataFrame:
    """H-3: cut the opening section that is mostly capitals; the text becomes its surviving words."""
    step = docs.withColumn("_words", T.split_and_clean(F.col("contents"), remove_non_alpha))
    # an ordinary text falls below the threshold at once; only the others need the long look
    head = F.array_join(F.slice("_words", 1, ALWAYS_WORDS + 2), "")
    plain = (F.size("_words") >= ALWAYS_WORDS + 2) & (T.count_upper(head) / F.length(head) < share)
    step = step.withColumn("_look", F.when(plain, ALWAYS_WORDS + 2).otherwise(FIRST_WORDS))
    sizes = F.transform(
        F.slice("_words", F.lit(1), F.col("_look")),
        lambda w: F.struct(T.count_upper(w).alias("caps"), F.length(w).alias("len")),
    )
    step = step.withColumn("_sizes", sizes)

    # words before the running share of capitals first falls below the threshold
    state = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("caps"), F.lit(0).alias("len"), F.lit(-1).alias("cut")
    )

    def advance(acc: Column, word: Column) -> Column:
        caps, length = acc["caps"] + word["caps"], acc["len"] + word["len"]
        below = (acc["cut"] < 0) & (acc["i"] > ALWAYS_WORDS) & (caps / length < share)
        return F.struct(
            (acc["i"] + 1).alias("i"), caps.alias("caps"), length.alias("len"),
            F.when(below, acc["i"]).otherwise(acc["cut"]).alias("cut"),
        )

    cut = F.aggregate("_sizes", state, advance, lambda acc: acc["cut"])
    step = step.withColumn("_cut", cut)
    first = F.when(F.col("_cut") >= 0, F.col("_cut")).otherwise(F.greatest(F.size("_sizes") - 1, F.lit(0)))
    step = step.withColumn("_first", F.slice("_sizes", F.lit(1), first))

    # the first chunk below the threshold, or the last chunk
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x[f])
    starts = F.sequence(F.lit(1), F.size("_first"), F.lit(CHUNK_WORDS))
    chunk = lambda s: F.slice("_first", s, CHUNK_WORDS)
    shares = F.when(
        F.size("_first") > 0,
        F.transform(starts, lambda s: total(chunk(s), "caps") / total(chunk(s), "len")),
    )
    step = step.withColumn("_shares", F.coalesce(shares, F.array().cast("array<double>")))
    below = F.filter(
        F.transform("_shares", lambda x, i: F.struct((x < share).alias("low"), i.alias("i"))),
        lambda c: c["low"] & (c["i"] > ALWAYS_CHUNKS),
    )
    chosen = F.coalesce(F.get(below, 0)["i"], F.size("_shares") - 1)
    step = step.withColumn("_chunk", chosen)
    step = step.withColumn("_share", F.get("_shares", F.col("_chunk")))

    # chunks before it, and the capital words that open it
    word_share = lambda w: w["caps"] / w["len"]
    tail = F.slice("_first", F.greatest(F.col("_chunk"), F.lit(0)) * CHUNK_WORDS + 1, CHUNK_WORDS)
    lows = F.array_position(F.transform(tail, lambda w: word_share(w) < share), True)
    leading = F.when(lows > 0, lows - 1).otherwise(F.size(tail))
    length = F.when(F.size("_first") > 0, F.col("_chunk") * CHUNK_WORDS + leading).otherwise(0)
    step = step.withColumn("_length", length.cast("int"))

    # drop words from its end until one has a larger share than that chunk; keep at least one
    larger = F.filter(
        F.transform(
            F.slice("_first", F.lit(1), F.col("_length")),
            lambda w, i: F.when(word_share(w) > F.col("_share"), i + 1),
        ),
        lambda i: i.isNotNull(),
    )
    kept = F.when(
        F.col("_length") > 0, F.coalesce(F.array_max(larger), F.lit(1))
    ).otherwise(0)
    rest = F.array_join(F.slice("_words", kept + 1, F.greatest(F.size("_words"), F.lit(1))), " ")
    step = step.withColumn("_rest", T.strip(rest))
    contents = F.when(F.size("_words") > 0, F.col("_rest")).otherwise(F.col("contents"))
    return step.withColumn("contents", contents).drop(
        "_words", "_look", "_sizes", "_cut", "_first", "_shares", "_chunk", "_share", "_length", "_rest"
    )


def split_candidates(docs: DataFrame) -> DataFrame:
    """Neighbouring tokens ``(patent, at, tok, next, joined)`` that might be one split word."""
    tokens = T.split_words(F.col("contents"))
    follow = F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0)))
    pairs = (
        docs.select("patent", tokens.alias("_t"))
        .where(F.size("_t") > 1)
        .withColumn("_n", follow)
        .select("patent", F.posexplode(F.arrays_zip(F.col("_t").alias("tok"), F.col("_n").alias("next"))))
        .select("patent", F.col("pos").alias("at"), "col.tok", "col.next")
        .where("next IS NOT NULL")
    )
    long = F.length("tok") + F.length("next") >= MIN_JOINED
    return pairs.where(long).withColumn("joined", F.concat("tok", "next"))


def lexicon_lookup(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """C-13: candidates of a first part in letters whose joined form is a word while the parts, by the rule, are not.

    The joined form is looked up first: few neighbours form a word, so the two lookups of the parts,
    whose keys are as uneven as language is, see little data. The pattern is tested on what all three leave: as one
    expression with the last lookup it is not moved ahead of them.
    """
    words = lexicon.select("word").distinct()
    hits = candidates.join(words.withColumnRenamed("word", "joined"), "joined", "left_semi")
    hits = hits.join(words.withColumnRenamed("word", "tok"), "tok", "left_anti")
    known = words.select(F.col("word").alias("next"), F.lit(True).alias("_known"))
    odd_letter = (F.length("next") == 1) & ~F.col("next").isin(*T.SINGLE_LETTER_WORDS)
    split = F.when(F.col("_known").isNull() | odd_letter, F.col("tok").rlike(r"^\p{L}+$"))
    return hits.join(known, "next", "left").where(split).drop("_known")


def merges(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """W-1: token positions that merge with their successor: every second one of a run."""
    hits = lexicon_lookup(split_candidates(docs), lexicon).select("patent", "at")
    run = F.col("at") - F.row_number().over(Window.partitionBy("patent").orderBy("at"))
    inside = Window.partitionBy("patent", "_run").orderBy("at")
    return (
        hits.withColumn("_run", run)
        .withColumn("_step", F.row_number().over(inside) - 1)
        .where("_step % 2 = 0")
        .select("patent", "at")
    )


def reassemble_words(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """H-2: re-join words that scanning cut in two; white space is normalised on the way.

    Adds ``words_reassembled``. ``patent`` identifies a document.
    """
    found = merges(docs, lexicon).groupBy("patent").agg(F.sort_array(F.collect_list("at")).alias("_at"))
    none = F.array().cast("array<int>")
    step = docs.join(found, "patent", "left").withColumn("_at", F.coalesce("_at", none))
    step = step.withColumn("_t", T.split_words(F.col("contents")))
    ends = F.concat(F.col("_at"), F.array(F.size("_t")))
    # the tokens between two merges, followed by the merged word
    piece = lambda end, i: F.concat(
        F.slice(
            "_t",
            F.when(i > 0, F.get("_at", i - 1) + 3).otherwise(1),
            end - F.when(i > 0, F.get("_at", i - 1) + 2).otherwise(0),
        ),
        F.when(
            i < F.size("_at"), F.array(F.concat(F.get("_t", end), F.get("_t", end + 1)))
        ).otherwise(F.array().cast("array<string>")),
    )
    whole = F.array_join("_t", " ")  # of a text without merges
    text = F.when(F.size("_at") == 0, whole).otherwise(F.array_join(F.flatten(F.transform(ends, piece)), " "))
    step = step.withColumn("_text", text).withColumn("words_reassembled", F.size("_at"))
    return step.withColumn("contents", F.col("_text")).drop("_at", "_t", "_text").select(
        *docs.columns, "words_reassembled"
    )


@dataclass(frozen=True)
class Preprocessor:
    """H-6: the settings of a cleaning run."""

    keep_empty_patents: bool = False
    keep_missing_years: bool = False
    keep_caps: bool = False
    keep_start_section: bool = False
    remove_non_alpha: bool = False

    kind = "Preprocessor"
    search = {  # J-3
        "keep_caps": [True, False],
        "keep_start_section": [True, False],
        "remove_non_alpha": [True, False],
    }

    def settings(self) -> dict:
        return asdict(self)

    def accepted(self, docs: DataFrame, max_per_year: int | None = None) -> DataFrame:
        docs = filter_empty(filter_missing_year(docs, self.keep_missing_years), self.keep_empty_patents)
        return docs if max_per_year is None else limit_per_year(docs, max_per_year)

    def clean(
        self, docs: DataFrame, lexicon: DataFrame | None = None, max_per_year: int | None = None
    ) -> DataFrame:
        """Filter, then H-1 to H-5 in order; other columns pass through."""
        columns = docs.columns
        out = self.accepted(docs, max_per_year)
        out = out.withColumn("contents", T.remove_unprintable(F.col("contents")))
        if lexicon is not None:
            out = reassemble_words(out, lexicon)
        if not self.keep_start_section:
            out = remove_start_section(out, remove_non_alpha=self.remove_non_alpha)
        cleaned = T.clean_words(F.col("contents"), self.keep_caps, self.remove_non_alpha)
        return out.withColumn("contents", T.remove_remains(cleaned)).select(*columns)


@dataclass(frozen=True)
class WordListPreprocessor:
    """H-7: the older cleaning by word lists.

    Each list is a tuple, or a table of any length: words or symbols in the first column, for ``greek`` the variant and
    the standard in the first two. Only the distinct words of a document meet the lists, by a join.
    """

    keep_missing_years: bool = False
    keep_empty_patents: bool = False
    stop_words: tuple[str, ...] | DataFrame = ()
    symbols: tuple[str, ...] | DataFrame = ()
    greek: tuple[tuple[str, str], ...] | DataFrame = ()

    kind = "WordListPreprocessor"
    search = {}

    def settings(self) -> dict:
        return {
            "keep_missing_years": self.keep_missing_years,
            "keep_empty_patents": self.keep_empty_patents,
        }

    def accepted(self, docs: DataFrame, max_per_year: int | None = None) -> DataFrame:
        docs = filter_empty(filter_missing_year(docs, self.keep_missing_years), self.keep_empty_patents)
        return docs if max_per_year is None else limit_per_year(docs, max_per_year)

    def swaps(self, spark: SparkSession) -> DataFrame:
        """``(token, stem)``: the Greek standard of a variant, the empty string for an unwanted word."""

        def rows(words, width: int) -> DataFrame:
            if isinstance(words, DataFrame):
                pair = [F.col(c).alias(n) for c, n in zip(words.columns[:width], ("token", "stem"))]
                return words.select(*pair, *([] if width == 2 else [F.lit("").alias("stem")]))
            pairs = [tuple(w) if width == 2 else (w, "") for w in words]
            return spark.createDataFrame(pairs, "token string, stem string")

        unwanted = rows(self.stop_words, 1).unionByName(rows(self.symbols, 1))
        # a standard is greater than the empty string; of several standards the greatest
        return unwanted.unionByName(rows(self.greek, 2)).groupBy("token").agg(F.max("stem").alias("stem"))

    @staticmethod
    def normal_word(word: Column) -> Column:
        """A lower-cased word, or the empty string when its form is rejected."""
        bad = (
            (F.length(word) < 2)
            | ~word.rlike(r"^\p{L}+$")
            | word.rlike(r"^[mdcxvi]+[a-z]$")
            | word.rlike(rf"({T.WORD})\1\1")
        )
        return F.when(bad, F.lit("")).otherwise(word)

    def clean(
        self, docs: DataFrame, stems: DataFrame | None = None, max_per_year: int | None = None
    ) -> DataFrame:
        """Words are replaced in place, separators stay. ``stems(token, stem)`` is an optional table."""
        out = self.accepted(docs, max_per_year)
        pieces = F.regexp_extract_all(F.col("contents"), F.lit(f"({T.WORD}+|[^\\p{{L}}\\p{{N}}_]+)"), F.lit(1))
        is_word = lambda p: p.rlike(f"^{T.WORD}")
        lowered = F.transform(pieces, lambda p: F.when(is_word(p), F.lower(p)).otherwise(p))
        out = out.withColumn("_p", lowered)
        if any(isinstance(x, DataFrame) or x for x in (self.stop_words, self.symbols, self.greek)):
            out = with_replacements(out, self.swaps(docs.sparkSession))
            listed = lambda p: F.try_element_at("_stems", p)
            swapped = lambda p: F.coalesce(listed(p), self.normal_word(p))
        else:
            swapped = self.normal_word
        out = out.withColumn("_p", F.transform("_p", lambda p: F.when(is_word(p), swapped(p)).otherwise(p))).drop("_stems")
        if stems is None:
            final = F.transform(
                "_p", lambda p: F.when(is_word(p) & (F.length(p) < 2), F.lit("")).otherwise(p)
            )
            return out.withColumn("contents", F.array_join(final, "")).drop("_p")
        return stem_pieces(out, stems)


def with_replacements(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``_stems``, the replacements ``table(token, stem)`` of the words in ``_p``, looking up each document's vocabulary once."""
    is_word = lambda p: p.rlike(f"^{T.WORD}")
    vocabulary = docs.select(
        "patent", F.explode(F.array_distinct(F.filter("_p", is_word))).alias("token")
    )
    changed = vocabulary.join(table, "token").groupBy("patent").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "stem"))).alias("_stems")
    )
    return docs.join(changed, "patent", "left")


def stem_pieces(docs: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace the word pieces of ``_p`` by their stems."""
    is_word = lambda p: p.rlike(f"^{T.WORD}")
    stemmed = lambda p: F.coalesce(F.try_element_at("_stems", p), p)
    final = F.transform(
        "_p",
        lambda p: F.when(~is_word(p), p).otherwise(
            F.when(F.length(stemmed(p)) < 2, F.lit("")).otherwise(stemmed(p))
        ),
    )
    changed = with_replacements(docs, stems.where("stem <> token"))
    return changed.withColumn("contents", F.array_join(final, "")).drop("_p", "_stems")
