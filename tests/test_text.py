"""Literal and property tests of the text rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import clean as C


def texts(spark, *values):
    rows = [(i, v, 1900) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "patent long, contents string, year int")


def apply(spark, expression, *values):
    rows = texts(spark, *values).select("patent", expression(F.col("contents")).alias("out"))
    return [r["out"] for r in rows.orderBy("patent").collect()]


def test_remove_unprintable(spark):
    assert apply(spark, T.remove_unprintable, "café — a\U0001f600b") == ["caf  a\U0001f600b"]


def test_remove_remains(spark):
    values = ["this  is . a , test .", "co-op a..b ...x y...", "  -- end"]
    assert apply(spark, T.remove_remains, *values) == ["this is a test", "co-op a..b .x y.", "end"]


def test_clean_words(spark):
    assert apply(spark, T.clean_words, "I See BB aaab x 7 a no1") == ["i see     a no1"]
    alpha = lambda c: T.clean_words(c, keep_caps=True, remove_non_alpha=True)
    assert apply(spark, alpha, "I See no1 x_y ok") == ["I See   ok"]


def test_chunks_and_capitals(spark):
    row = spark.range(1).select(
        T.chunk(F.split(F.lit("a b c d e"), " "), 2).alias("c"), T.count_upper(F.lit("AbCd")).alias("n"),
        T.ngrams(F.split(F.lit("a b c"), " "), 2).alias("g"),
    ).first()
    assert row["c"] == [["a", "b"], ["c", "d"], ["e"]] and row["n"] == 2 and row["g"] == ["a b", "b c"]


def keep_word(word):
    low = word.lower()
    if len(low) < 2 and low not in ("a", "i"):
        return False
    return not re.search(r"\b([a-z])\1+\b", low) and not re.search(r"([a-z])\1\1", low)


def start_section(text, share):
    """The rule for one text, word by word."""
    words = [w for w in text.split() if keep_word(w)]
    if not words:
        return text
    caps = [sum(c.isupper() for c in w) for w in words]
    n = min(len(words), 1000)
    k = n - 1
    for i in range(11, n):
        if sum(caps[: i + 1]) / sum(map(len, words[: i + 1])) < share:
            k = i
            break
    if k == 0:
        return " ".join(words)
    ratio = lambda a, b: sum(caps[a:b]) / sum(map(len, words[a:b]))
    groups = [(a, min(a + 3, k)) for a in range(0, k, 3)]
    c = next((g for g in range(11, len(groups)) if ratio(*groups[g]) < share), len(groups) - 1)
    limit, end = ratio(*groups[c]), groups[c][0]
    while end < groups[c][1] and ratio(end, end + 1) >= share:
        end += 1
    if end:
        larger = [i + 1 for i in range(end) if ratio(i, i + 1) > limit]
        end = max(larger) if larger else 1
    return " ".join(words[end:])


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_start_section_of_random_texts(spark, share):
    rng = random.Random(5)
    pool = ["UNITED", "STATES", "Patent", "office", "a", "of", "B", "Zz", "the", "X1", "FiLED", "lever"]
    values = [""]
    for _ in range(150):
        head = rng.choices(pool[:5], k=rng.randint(0, 50))
        values.append(" ".join(head + rng.choices(pool, k=rng.randint(0, 60))))
    got = C.remove_start_section(texts(spark, *values), share).orderBy("patent").collect()
    assert [r["contents"] for r in got] == [start_section(t, share) for t in values]


def test_reassemble_words(spark):
    lexicon = spark.createDataFrame([("mechanism",), ("member",), ("in",), ("bar",)], "word string")
    docs = texts(spark, "the mecha nism in  a mem ber bar", "mem ber mem ber", "Mem ber", "")
    got = C.reassemble_words(docs, lexicon).orderBy("patent").collect()
    assert [(r["contents"], r["words_reassembled"]) for r in got] == [
        ("the mechanism in a member bar", 2), ("member member", 2), ("Mem ber", 0), ("", 0)
    ]


def test_pattern_is_tested_after_the_lookups(spark):
    """the letters of a first part are tested on what the lexicon leaves, not on every token of the texts."""
    lexicon = spark.createDataFrame([("mechanism",), ("3member",), ("in",)], "word string")
    found = C.lexicon_lookup(C.split_candidates(texts(spark, "the mecha nism", "3mem ber", "mecha nism\u2003mecha\x0bnism")), lexicon)
    assert sorted((r["patent"], r["at"]) for r in found.collect()) == [(0, 1), (2, 0), (2, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins, tests = ([i for i, x in enumerate(plan) if w in x] for w in ("Join", "RLIKE"))
    assert len(joins) == 3 and len(tests) == 1 and tests[0] < joins[0]


def test_white_space_of_words(spark):
    """Both forms of the class hold the same characters."""
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert chars.where(F.col("c").rlike(f"[{T.SPACES}]") != F.col("c").rlike(T.SPACE)).count() == 0
    assert chars.where(F.col("c").rlike(T.SPACE)).count() == len(T.SPACE_CHARS)


def test_filters_count_year_before_text(spark):
    docs = spark.createDataFrame(
        [(1, "f", "x", 1900), (2, "f", "", 0), (3, "f", "", 1900), (4, "g", "y", None)],
        "patent long, file string, contents string, year int",
    )
    assert [r["patent"] for r in C.Preprocessor().accepted(docs).collect()] == [1]
    counted = C.filter_stats(docs.withColumn("words_reassembled", F.lit(2))).where("file IS NULL").first()
    assert counted["words_reassembled"] == 2 * docs.count()
    stats = {r["file"]: r for r in C.filter_stats(docs).collect()}
    assert (stats["f"]["processed"], stats["f"]["skipped_empty"], stats["f"]["skipped_no_year"]) == (1, 1, 1)
    assert stats[None]["skipped_no_year"] == 2
    kept = C.Preprocessor(keep_missing_years=True, keep_empty_patents=True).accepted(docs)
    assert kept.count() == 4


def test_word_lists(spark):
    prep = C.WordListPreprocessor(stop_words=("the",), symbols=("fig",), greek=(("alfa", "alpha"),))
    docs = texts(spark, "The Alfa-beta xiv fig. 12 aaa levers")
    assert prep.clean(docs).first()["contents"] == " alpha-beta  .   levers"
    stems = spark.createDataFrame([("levers", "lever"), ("beta", "b")], "token string, stem string")
    assert prep.clean(docs, stems).first()["contents"] == " alpha-  .   lever"
    long = spark.range(50_000).selectExpr("concat('stop', cast(id as string)) AS word").union(spark.createDataFrame([("the",)], "word string"))
    symbols = spark.createDataFrame([("fig",)], "symbol string")
    greek = spark.createDataFrame([("alfa", "alpha")], "variant string, standard string")
    tables = C.WordListPreprocessor(stop_words=long, symbols=symbols, greek=greek)
    assert tables.clean(docs).first()["contents"] == " alpha-beta  .   levers"
    assert C.WordListPreprocessor().clean(docs).first()["contents"] == "the alfa-beta  fig.   levers"


def test_extra_columns_pass_through(spark):
    docs = texts(spark, "Some Text here").withColumn("extra", F.lit(7))
    assert C.Preprocessor().clean(docs).columns == ["patent", "contents", "year", "extra"]


def test_terms_are_counted_in_their_row(spark):
    """counts of terms shuffle nothing but ids; rows of a repeated id, null ids among them, are added up."""
    from tidemark.operators import embed as E

    rows = [(1, 1900, "b a b"), (2, 1900, ""), (3, 1900, None), (4, 1901, "a b c"), (4, 1901, "c c"), (None, 1901, "x"), (None, 1901, "x y")]
    docs = spark.createDataFrame(rows, "patent long, year int, contents string")
    tokens = docs.select("patent", "year", F.split("contents", " ").alias("tokens"))
    once = tokens.where("patent < 4")
    got = E.term_counts(once, 2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.where("patent = 1").collect()} == {
        (1, 1900, 1, "a", 1), (1, 1900, 1, "b", 2), (1, 1900, 2, "b a", 1), (1, 1900, 2, "a b", 1),
    }
    found = {(r["patent"], r["order"], r["term"]): r["tf"] for r in E.term_counts(tokens, 2).where("year = 1901").collect()}
    assert found == {
        (4, 1, "a"): 1, (4, 1, "b"): 1, (4, 1, "c"): 3, (4, 2, "a b"): 1, (4, 2, "b c"): 1, (4, 2, "c c"): 1,
        (None, 1, "x"): 2, (None, 1, "y"): 1, (None, 2, "x y"): 1,
    }
