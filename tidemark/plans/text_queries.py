"""Queries over document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import clean as C
from tidemark.plans import views as v
from tidemark.plans.catalog import query

W, S = v.WORD_CLASS, v.SPACE_CLASS


def pieces(t: str) -> str:
    return f"regexp_extract_all({t}, '[{W}]+|[^{W}]+')"


def unprintable(t: str) -> str:
    return f"regexp_replace({t}, '[\\x{{80}}-\\x{{FFFF}}]+', '', 'g')"


def clean_sql(t: str, keep_caps: bool = False, remove_non_alpha: bool = False) -> str:
    alpha = r" OR NOT regexp_full_match(lower(w), '\p{L}+')" if remove_non_alpha else ""
    kept = "w" if keep_caps else "lower(w)"
    return (
        f"array_to_string(list_transform({pieces(t)}, lambda w: CASE "
        f"WHEN NOT regexp_matches(w, '^[{W}]') THEN w "
        "WHEN length(w) < 2 AND lower(w) NOT IN ('a', 'i') "
        f"OR regexp_full_match(lower(w), '{v.RUNS}') OR regexp_matches(lower(w), '{v.TRIPLES}'){alpha} "
        f"THEN '' ELSE {kept} END), '')"
    )


def remains_sql(t: str) -> str:
    """Protect the first and last mark of a run that touches a word, delete the other marks."""
    mark = rf"[^{W}{S}\x01\x02]"
    after = rf"regexp_replace({t}, '([{W}])([^{W}{S}])', '\1' || chr(1) || '\2' || chr(2), 'g')"
    before = rf"regexp_replace({after}, '({mark})([{W}])', chr(1) || '\1' || chr(2) || '\2', 'g')"
    rest = rf"regexp_replace({before}, '\x01([^\x02]*)\x02|{mark}', '\1', 'g')"
    return f"regexp_replace(regexp_replace({rest}, ' +', ' ', 'g'), '^[{S}]+|[{S}]+$', '', 'g')"


def digest(rows, *extra):
    """Texts as digests and lengths, to compare whole texts without shipping them."""
    return rows.select("patent", *extra, F.md5("contents").alias("digest"), F.length("contents").alias("chars"))


DIGEST = "SELECT patent, md5(contents) AS digest, length(contents) AS chars FROM "


def step(name, sql_expression, spark_expression, doc):
    @query(name, v.sql_with(v.DOCS) + DIGEST + f"(SELECT patent, {sql_expression} AS contents FROM docs)")
    def run(spark, sf):
        return digest(v.docs(spark, sf).withColumn("contents", spark_expression(F.col("contents"))))

    run.__doc__ = doc
    return run


step("remove_unprintable", unprintable("contents"), T.remove_unprintable, "H-1")
step("clean_document", clean_sql("contents"), T.clean_words, "H-4")
step(
    "clean_document_alpha", clean_sql("contents", True, True),
    lambda c: T.clean_words(c, keep_caps=True, remove_non_alpha=True), "H-4 with both options",
)
step("remove_remains", remains_sql("contents"), T.remove_remains, "H-5")
step(
    "collapse_whitespace", f"trim(regexp_replace(contents, '[{S}]+', ' ', 'g'))", T.collapse_whitespace, "H-11"
)


@query(
    "filter_missing_year",
    v.sql_with(v.GAPS) + "SELECT patent, year FROM docs WHERE year <> 0",
)
def filter_missing_year(spark, sf):
    return C.filter_missing_year(v.docs_with_gaps(spark, sf)).select("patent", "year")


@query("filter_empty", v.sql_with(v.GAPS) + "SELECT patent, length(contents) AS chars FROM docs WHERE contents <> ''")
def filter_empty(spark, sf):
    return C.filter_empty(v.docs_with_gaps(spark, sf)).select("patent", F.length("contents").alias("chars"))


@query(
    "prep_stats",
    v.sql_with(v.GAPS)
    + "SELECT file, count(*) FILTER (year <> 0 AND contents <> '') AS processed, "
    "count(*) FILTER (year <> 0 AND contents = '') AS skipped_empty, count(*) FILTER (year = 0) AS skipped_no_year "
    "FROM docs GROUP BY ROLLUP (file)",
)
def prep_stats(spark, sf):
    """G-14."""
    return C.filter_stats(v.docs_with_gaps(spark, sf))


@query(
    "count_capitals",
    v.sql_with(v.DOCS)
    + r"SELECT patent, length(regexp_replace(contents, '[^\p{Lu}]', '', 'g')) AS capitals FROM docs",
)
def count_capitals(spark, sf):
    """H-8."""
    return v.docs(spark, sf).select("patent", T.count_upper(F.col("contents")).alias("capitals"))


SURVIVES = (
    "(length(w) >= 2 OR lower(w) IN ('a', 'i')) "
    f"AND NOT regexp_matches(lower(w), '{v.TRIPLES}') "
    f"AND NOT regexp_matches(lower(w), '(^|[^{W}])({v.RUNS})($|[^{W}])')"
)
WORDS = (
    f"raw AS (SELECT patent, unnest(string_split_regex(contents, '[{S}]+')) AS w, "
    f"generate_subscripts(string_split_regex(contents, '[{S}]+'), 1) AS ord FROM docs), "
    f"words AS (SELECT patent, w, row_number() OVER (PARTITION BY patent ORDER BY ord) - 1 AS i FROM raw WHERE w <> '' AND {SURVIVES})"
)


@query(
    "split_and_clean",
    v.sql_with(v.DOCS, WORDS)
    + "SELECT patent, count(w) AS words, md5(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS digest "
    "FROM docs LEFT JOIN words USING (patent) GROUP BY patent",
)
def split_and_clean(spark, sf):
    """H-10."""
    rows = v.docs(spark, sf).select("patent", T.split_and_clean(F.col("contents")).alias("words"))
    return rows.select("patent", F.size("words").alias("words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(
    "chunk_words",
    v.sql_with(v.DOCS, WORDS)
    + "SELECT patent, i // 100 AS chunk, string_agg(w, ' ' ORDER BY i) AS words FROM words GROUP BY ALL",
)
def chunk_words(spark, sf):
    """H-9: chunks of a hundred words."""
    words = v.docs(spark, sf).select("patent", T.split_and_clean(F.col("contents")).alias("words"))
    chunks = words.select("patent", F.posexplode(T.chunk(F.col("words"), 100)).alias("chunk", "words"))
    return chunks.select("patent", F.col("chunk").cast("long").alias("chunk"), F.array_join("words", " ").alias("words"))


def start_section_sql(share: float) -> str:
    """The rule of H-3 with ranks and running sums over one row per word."""
    return (
        r"sized AS (SELECT patent, i, w, length(regexp_replace(w, '[^\p{Lu}]', '', 'g')) AS caps, length(w) AS len FROM words), "
        "running AS (SELECT *, sum(caps) OVER o / sum(len) OVER o AS share FROM sized WHERE i < 1000 "
        "WINDOW o AS (PARTITION BY patent ORDER BY i)), "
        f"cuts AS (SELECT patent, coalesce(min(i) FILTER (i > 10 AND share < {share}), max(i)) AS k FROM running GROUP BY patent), "
        "firsts AS (SELECT s.*, s.i // 3 AS c FROM sized s JOIN cuts USING (patent) WHERE s.i < k), "
        "chunks AS (SELECT patent, c, sum(caps) / sum(len) AS share FROM firsts GROUP BY ALL), "
        f"chosen AS (SELECT patent, coalesce(min(c) FILTER (c > 10 AND share < {share}), max(c)) AS c FROM chunks GROUP BY patent), "
        "with_share AS (SELECT patent, c, share FROM chosen JOIN chunks USING (patent, c)), "
        "openings AS (SELECT f.patent, f.c, any_value(x.share) AS share, "
        f"coalesce(min(f.i) FILTER (f.caps / f.len < {share}), max(f.i) + 1) AS ending "
        "FROM firsts f JOIN with_share x USING (patent, c) GROUP BY ALL), "
        "prefixes AS (SELECT l.patent, l.ending, max(f.i + 1) FILTER (f.i < l.ending AND f.caps / f.len > l.share) AS kept "
        "FROM openings l JOIN firsts f USING (patent) GROUP BY ALL), "
        "lengths AS (SELECT patent, CASE WHEN ending = 0 THEN 0 ELSE coalesce(kept, 1) END AS n FROM prefixes), "
        "rest AS (SELECT w.patent, string_agg(w.w, ' ' ORDER BY w.i) FILTER (w.i >= coalesce(n, 0)) AS contents "
        "FROM words w LEFT JOIN lengths USING (patent) GROUP BY w.patent), "
        "started AS (SELECT d.patent, CASE WHEN r.patent IS NULL THEN d.contents ELSE coalesce(r.contents, '') END AS contents "
        "FROM docs d LEFT JOIN rest r USING (patent))"
    )


# every document gets an opening of capitals, its length taken from the id
OPENING = "repeat('UNITED STATES Patent OFFICE ', CAST(doc_id % 40 AS INTEGER)) || text"
OPENED = (
    f"docs AS (SELECT doc_id AS patent, {OPENING} AS contents, "
    "CAST(1900 + doc_id % 25 AS INTEGER) AS year FROM documents)"
)


def opened_docs(spark, sf):
    opening = F.repeat(F.lit("UNITED STATES Patent OFFICE "), (F.col("patent") % 40).cast("int"))
    return v.docs(spark, sf).withColumn("contents", F.concat(opening, "contents"))


@query("remove_start_section", v.sql_with(OPENED, WORDS, start_section_sql(0.6)) + DIGEST + "started")
def remove_start_section(spark, sf):
    """H-3, W-2."""
    return digest(C.remove_start_section(opened_docs(spark, sf)))


@query(
    "remove_start_section_raw", v.sql_with(v.DOCS, WORDS, start_section_sql(0.3)) + DIGEST + "started"
)
def remove_start_section_raw(spark, sf):
    """H-3 on the texts as they are, with another threshold."""
    return digest(C.remove_start_section(v.docs(spark, sf), 0.3))


TOKENS = (
    f"raw AS (SELECT patent, unnest(string_split_regex(contents, '[{S}]+')) AS w, "
    f"generate_subscripts(string_split_regex(contents, '[{S}]+'), 1) AS ord FROM docs), "
    "tokens AS (SELECT patent, w, row_number() OVER (PARTITION BY patent ORDER BY ord) - 1 AS ord FROM raw WHERE w <> '')"
)
LOOKUP = (
    "paired AS (SELECT patent, ord, w AS tok, lead(w) OVER (PARTITION BY patent ORDER BY ord) AS nxt FROM tokens), "
    "hits AS (SELECT patent, ord, tok, nxt FROM paired WHERE nxt IS NOT NULL "
    r"AND regexp_full_match(tok, '\p{L}+') AND length(tok || nxt) >= 5 "
    "AND tok NOT IN (SELECT word FROM lexicon) AND tok || nxt IN (SELECT word FROM lexicon) "
    "AND (nxt NOT IN (SELECT word FROM lexicon) OR length(nxt) = 1 AND nxt NOT IN ('a', 'i')))"
)
MERGED = (
    "runs AS (SELECT *, ord - row_number() OVER (PARTITION BY patent ORDER BY ord) AS run FROM hits), "
    "merged AS (SELECT patent, ord FROM (SELECT patent, ord, row_number() OVER (PARTITION BY patent, run ORDER BY ord) AS step "
    "FROM runs) WHERE step % 2 = 1), "
    "glued AS (SELECT t.patent, t.ord, CASE WHEN m.ord IS NOT NULL THEN t.w || lead(t.w) OVER (PARTITION BY t.patent ORDER BY t.ord) "
    "ELSE t.w END AS w, p.ord IS NOT NULL AS gone, m.ord IS NOT NULL AS joined FROM tokens t "
    "LEFT JOIN merged m ON m.patent = t.patent AND m.ord = t.ord LEFT JOIN merged p ON p.patent = t.patent AND p.ord = t.ord - 1), "
    "whole AS (SELECT d.patent, coalesce(string_agg(g.w, ' ' ORDER BY g.ord) FILTER (NOT g.gone), '') AS contents, "
    "CAST(count(*) FILTER (g.joined) AS INTEGER) AS words_reassembled FROM docs d LEFT JOIN glued g USING (patent) GROUP BY d.patent)"
)


@query(
    "lexicon_lookup", v.sql_with(v.SPLIT, v.LEXICON, TOKENS, LOOKUP) + "SELECT patent, ord AS pos, tok, nxt AS next FROM hits"
)
def lexicon_lookup(spark, sf):
    """C-13."""
    hits = C.lexicon_lookup(C.split_candidates(v.split_docs(spark, sf)), v.lexicon(spark, sf))
    return hits.select("patent", F.col("at").cast("long").alias("pos"), "tok", "next")


@query(
    "reassemble_words",
    v.sql_with(v.SPLIT, v.LEXICON, TOKENS, LOOKUP, MERGED)
    + "SELECT patent, words_reassembled, md5(contents) AS digest, length(contents) AS chars FROM whole",
)
def reassemble_words(spark, sf):
    """H-2, W-1."""
    return digest(C.reassemble_words(v.split_docs(spark, sf), v.lexicon(spark, sf)), "words_reassembled")


@query(
    "preprocess",
    v.sql_with(
        v.GAPS.replace("docs AS", "gaps AS"),
        f"docs AS (SELECT patent, year, {unprintable('contents')} AS contents FROM gaps WHERE year <> 0 AND contents <> '')",
        WORDS, start_section_sql(0.6),
        f"cleaned AS (SELECT patent, {clean_sql('contents')} AS contents FROM started)",
    )
    + DIGEST + f"(SELECT patent, {remains_sql('contents')} AS contents FROM cleaned)",
)
def preprocess(spark, sf):
    """H-6 without a lexicon."""
    return digest(C.Preprocessor().clean(v.docs_with_gaps(spark, sf)))


@query(
    "preprocess_with_lexicon",
    v.sql_with(
        v.SPLIT.replace("docs AS", "parts AS"),
        f"docs AS (SELECT patent, {unprintable('contents')} AS contents FROM parts)",
        v.LEXICON, TOKENS, LOOKUP, MERGED,
        f"cleaned AS (SELECT patent, {clean_sql('contents', True, True)} AS contents FROM whole)",
    )
    + DIGEST + f"(SELECT patent, {remains_sql('contents')} AS contents FROM cleaned)",
)
def preprocess_with_lexicon(spark, sf):
    """H-6 with re-joined words, capitals and start section kept, letters only."""
    settings = C.Preprocessor(keep_caps=True, keep_start_section=True, remove_non_alpha=True)
    return digest(settings.clean(v.split_docs(spark, sf), v.lexicon(spark, sf)))


def old_word_sql(stems: bool) -> str:
    """One lower-cased word through the word lists; a stem strips a final "ion" or "s"."""
    unwanted = ", ".join(f"'{w}'" for w in v.STOP_WORDS + v.SYMBOLS)
    greek = " ".join(f"WHEN lower(w) = '{a}' THEN '{b}'" for a, b in v.GREEK)
    triples = "|".join(f"{c}{{3}}" for c in v.LETTERS)
    word = (
        f"CASE {greek} WHEN length(w) < 2 OR NOT regexp_full_match(lower(w), '\\p{{L}}+') "
        f"OR regexp_full_match(lower(w), '[mdcxvi]+[a-z]') OR regexp_matches(lower(w), '{triples}') "
        f"OR has_triple(lower(w)) OR lower(w) IN ({unwanted}) THEN '' ELSE lower(w) END"
    )
    # triples of letters beyond a-z: a letter equal to its two predecessors
    word = word.replace(
        "has_triple(lower(w))",
        "len(list_filter(range(3, length(w) + 1), lambda k: substr(lower(w), k, 1) = substr(lower(w), k - 1, 1) "
        "AND substr(lower(w), k, 1) = substr(lower(w), k - 2, 1))) > 0",
    )
    if stems:
        word = f"regexp_replace({word}, '(ion|s)$', '')"
    return word


def old_sql(stems: bool) -> str:
    return (
        v.sql_with(
            v.DOCS,
            f"replaced AS (SELECT patent, list_transform({pieces('contents')}, lambda w: CASE "
            f"WHEN NOT regexp_matches(w, '^[{W}]') THEN w ELSE {old_word_sql(stems)} END) AS p FROM docs)",
            f"final AS (SELECT patent, array_to_string(list_transform(p, lambda w: CASE "
            f"WHEN regexp_matches(w, '^[{W}]') AND length(w) < 2 THEN '' ELSE w END), '') AS contents FROM replaced)",
        )
        + DIGEST + "final"
    )


def word_lists():
    return C.WordListPreprocessor(stop_words=v.STOP_WORDS, symbols=v.SYMBOLS, greek=v.GREEK)


@query("preprocess_old", old_sql(False))
def preprocess_old(spark, sf):
    """H-7 without stems."""
    return digest(word_lists().clean(v.docs(spark, sf)))


@query("preprocess_old_stems", old_sql(True))
def preprocess_old_stems(spark, sf):
    """H-7 with a table of stems."""
    tokens = v.docs(spark, sf).select(F.explode(T.word_tokens(F.col("contents"))).alias("token")).distinct()
    standards = spark.createDataFrame([(b,) for _, b in v.GREEK], "token string")
    stem = F.regexp_replace("token", "(ion|s)$", "")
    stems = tokens.unionByName(standards).distinct().select("token", stem.alias("stem"))
    return digest(word_lists().clean(v.docs(spark, sf), stems))
