"""Queries over fitted and pretrained document vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T, vectors as V
from tidemark.operators import embed as E, scores as S
from tidemark.plans import views as v
from tidemark.plans.catalog import query

M = v.sql_members("docs")
EPOCHS = v.sql_windows(v.EPOCHS)
BASE = (v.DOCS, EPOCHS, M)
W, SP = v.WORD_CLASS, v.SPACE_CLASS
STOP = ", ".join(f"'{w}'" for w in v.STOP_WORDS)


def tokens_sql(stop: bool) -> str:
    """Lower-cased words of two or more characters with their place after stop-word removal."""
    keep = f"WHERE w NOT IN ({STOP})" if stop else ""
    return (
        f"found AS (SELECT patent, year, regexp_extract_all(lower(contents), '[{W}][{W}]+') AS ws FROM docs), "
        "placed AS (SELECT patent, year, unnest(ws) AS w, generate_subscripts(ws, 1) AS ord FROM found), "
        f"tokens AS (SELECT patent, year, w, row_number() OVER (PARTITION BY patent ORDER BY ord) AS ord FROM placed {keep})"
    )


BLANK_TOKENS = (
    f"placed AS (SELECT patent, year, unnest(string_split_regex(contents, '[{SP}]+')) AS w FROM docs), "
    "tokens AS (SELECT patent, year, w FROM placed WHERE w <> '')"
)
COUNTS = "counts AS (SELECT patent, year, w AS term, count(*) AS tf FROM tokens GROUP BY ALL)"
NGRAM_COUNTS = (
    "grams AS (SELECT patent, year, w AS term FROM tokens UNION ALL SELECT a.patent, a.year, a.w || ' ' || b.w "
    "FROM tokens a JOIN tokens b ON b.patent = a.patent AND b.ord = a.ord + 1), "
    "counts AS (SELECT patent, year, term, count(*) AS tf FROM grams GROUP BY ALL)"
)
WINDOW_COUNTS = (
    'wc AS (SELECT m."window", c.* FROM counts c JOIN members m USING (patent, year)), '
    'sizes AS (SELECT "window", count(*) AS n FROM members GROUP BY 1)'
)


def tfidf_sql(model: str, norm: str | None, sublinear: bool, min_df: int, max_df: float) -> str:
    length = {"l1": 'sum(w) OVER o', "l2": 'sqrt(sum(w * w) OVER o)', None: "1"}[norm]
    tf = "1 + ln(tf)" if sublinear else "tf"
    return (
        'dfs AS (SELECT "window", term, count(*) AS df FROM wc GROUP BY ALL), '
        'kept AS (SELECT "window", term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM dfs JOIN sizes USING ("window") '
        f"WHERE df >= least({min_df}, n) AND df <= greatest(least({min_df}, n) / n, {max_df}) * n), "
        f'weighted AS (SELECT "window", patent, year, term, ({tf}) * idf AS w FROM wc JOIN kept USING ("window", term)), '
        f"vectors AS (SELECT '{model}' AS model, \"window\", patent, year, term, w / {length} AS w FROM weighted "
        'WINDOW o AS (PARTITION BY "window", patent)) '
    )


ROWS = 'SELECT model, "window", patent, year, term, round(w, 9) AS w FROM vectors'
STOPPED = E.Tfidf(stop_words=v.STOP_WORDS)
BIGRAMS = E.Tfidf(ngram_max=2, stop_words=None, norm="l2", sublinear_tf=True, min_df=5, max_df=0.6)


def corpus(spark, sf, spec=v.EPOCHS):
    return E.Corpus.of(v.docs(spark, sf), spec.frame(spark))


@query(
    "tfidf", v.sql_with(*BASE, tokens_sql(True), COUNTS, WINDOW_COUNTS, tfidf_sql("tfidf", "l1", False, 3, 1.0)) + ROWS
)
def tfidf(spark, sf):
    """E-1, E-6 with the default settings and a short list of stop words."""
    return v.rounded(STOPPED.transform(corpus(spark, sf), "tfidf"), "w")


@query(
    "tfidf_ngrams",
    v.sql_with(*BASE, tokens_sql(False), NGRAM_COUNTS, WINDOW_COUNTS, tfidf_sql("bigrams", "l2", True, 5, 0.6)) + ROWS,
)
def tfidf_ngrams(spark, sf):
    """E-1 with bigrams, sublinear counts, unit length and both frequency limits."""
    return v.rounded(BIGRAMS.transform(corpus(spark, sf), "bigrams"), "w")


SAMPLE = (
    'sampled AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY '
    "CAST('0x' || substr(md5(\"window\" || '-' || patent || '-3'), 1, 15) AS BIGINT)) <= 50)"
)


@query(
    "embed_windows",
    v.sql_with(*BASE, tokens_sql(True), COUNTS, WINDOW_COUNTS, tfidf_sql("tfidf", None, False, 2, 1.0)) + ROWS,
)
def embed_windows(spark, sf):
    """E-6: every document of every window."""
    model = E.Tfidf(stop_words=v.STOP_WORDS, norm=None, min_df=2)
    return v.rounded(model.transform(corpus(spark, sf), "tfidf"), "w")


@query(
    "embed_sampled_windows",
    v.sql_with(
        *BASE, SAMPLE, tokens_sql(True), COUNTS,
        WINDOW_COUNTS.replace("JOIN members m", "JOIN sampled m").replace("FROM members", "FROM sampled"),
        tfidf_sql("tfidf", None, False, 2, 1.0),
    )
    + ROWS,
)
def embed_sampled_windows(spark, sf):
    """E-6 with P-1: a sample of fifty documents per window, as its sampling operator draws it."""
    from tidemark.operators.windows import sample_window

    members = sample_window(v.members(v.doc_years(spark, sf), v.EPOCHS), 50, seed=3)
    sampled = E.Corpus.of(v.docs(spark, sf), v.EPOCHS.frame(spark), members)
    model = E.Tfidf(stop_words=v.STOP_WORDS, norm=None, min_df=2)
    return v.rounded(model.transform(sampled, "tfidf"), "w")


@query(
    "doc_freq", v.sql_with(v.DOCS, BLANK_TOKENS) + "SELECT w AS token, count(DISTINCT patent) AS df FROM tokens GROUP BY w"
)
def doc_freq(spark, sf):
    """G-11, U-3."""
    return E.doc_freq(v.docs(spark, sf), T.split_words(F.col("contents")))


@query(
    "term_totals",
    v.sql_with(v.DOCS, BLANK_TOKENS, COUNTS)
    + "SELECT term, total, max(total) OVER () AS max_total, round(1.0 / total, 9) AS inverse FROM "
    "(SELECT term, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term)",
)
def term_totals(spark, sf):
    """G-12, S-5."""
    tokens = v.docs(spark, sf).select("patent", "year", T.split_words(F.col("contents")).alias("tokens"))
    totals = E.term_totals(E.term_counts(tokens, 1))
    return totals.withColumn("inverse", F.round(V.inverse_weight(F.col("total")), 9))


def countvec_sql(weight: str) -> str:
    return (
        v.sql_with(
            *BASE, BLANK_TOKENS, COUNTS, WINDOW_COUNTS,
            'totals AS (SELECT "window", term, sum(tf) AS total FROM wc GROUP BY ALL)',
            'largest AS (SELECT *, max(total) OVER (PARTITION BY "window") AS top FROM totals)',
            f'weighted AS (SELECT "window", patent, year, term, tf * ({weight}) AS w FROM wc JOIN largest USING ("window", term))',
            "vectors AS (SELECT 'counts' AS model, \"window\", patent, year, term, "
            'coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY "window", patent)), 0), 0) AS w FROM weighted)',
        )
        + ROWS
    )


@query("countvec", countvec_sql("1.0 / total"))
def countvec(spark, sf):
    """E-2, weights by inverse frequency."""
    return v.rounded(E.WeightedCounts("prop").transform(corpus(spark, sf), "counts"), "w")


@query("countvec_sigmoid", countvec_sql("1 - 1 / (1 + exp(least(-0.5 * (total - top / 2.0), 700)))"))
def countvec_sigmoid(spark, sf):
    """E-2, S-6: logistic weights."""
    return v.rounded(E.WeightedCounts("sigmoid").transform(corpus(spark, sf), "counts"), "w")


SIF_SUMS = ", ".join(f"sum(tf * f * v{k}) / sum(tf * f) AS d{k}" for k in range(1, 9))
SIF_OUT = ", ".join(f"round(d{k}, 9) AS d{k}" for k in range(1, 9))
LOWER_TOKENS = (
    "placed AS (SELECT patent, year, unnest(string_split(lower(contents), ' ')) AS w FROM docs), "
    "tokens AS (SELECT patent, year, w FROM placed WHERE w <> '')"
)


def blank_lower(text):
    return F.array_remove(F.split(F.lower(text), " "), "")


def sif(spark, sf, remove_common):
    model = E.TokenVectorMean(
        vector_size=8, token_vectors=v.token_vectors(spark, sf), tokenizer=blank_lower, remove_common=remove_common
    )
    return model.transform(corpus(spark, sf), "sif")


@query(
    "sif_embedding",
    v.sql_with(
        *BASE, LOWER_TOKENS, v.TOKEN_VECTORS, COUNTS, WINDOW_COUNTS,
        'factors AS (SELECT "window", term, 1 / (1 + 1000.0 * count(*) / any_value(n)) AS f FROM wc JOIN sizes USING ("window") GROUP BY ALL)',
        f'means AS (SELECT "window", patent, year, {SIF_SUMS} FROM wc JOIN factors USING ("window", term) '
        "JOIN token_vectors ON token = term GROUP BY ALL)",
    )
    + f'SELECT "window", patent, year, {SIF_OUT} FROM means',
)
def sif_embedding(spark, sf):
    """E-3, S-7, before the common direction is removed."""
    rows = sif(spark, sf, False)
    return rows.select("window", "patent", "year", *[F.round(F.get("embedding", k), 9).alias(f"d{k + 1}") for k in range(8)])


@query("sif_embedding_common_removed")
def sif_embedding_common_removed(spark, sf):
    """E-3 with the leading direction of each window removed (an eigenvector, so without SQL)."""
    return sif(spark, sf, True)


@query("doc2vec")
def doc2vec(spark, sf):
    """E-4: trained vectors, with the default size, epochs and least count."""
    from tidemark.operators.windows import WindowSpec

    windows = WindowSpec(1900, 1946, 36, 36).frame(spark)  # two windows that hold all documents
    rows = E.Corpus.of(v.docs(spark, sf), windows)
    return E.TrainedVectors().transform(rows, "doc2vec")


ENCODER = "prithivida/bert-for-patents-64d"
ENCODED = (
    f"placed AS (SELECT patent, CAST('0x' || substr(md5('{ENCODER}:' || w), 1, 8) AS BIGINT) AS h "
    "FROM (SELECT patent, unnest(string_split_regex(lower(contents), '\\s+')) AS w FROM docs) WHERE w <> ''), "
    "places AS (SELECT patent, h % 64 AS k, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS x FROM placed GROUP BY ALL), "
    "entries AS (SELECT patent, map_from_entries(list((k, x))) AS m FROM places GROUP BY patent), "
    "encoded AS (SELECT patent, year, array_to_string(list_transform(range(64), lambda k: "
    "CAST(CAST(coalesce(m[k], 0) AS INT) AS VARCHAR)), ',') AS embedding FROM docs LEFT JOIN entries USING (patent))"
)


def encoder():
    return E.PretrainedEncoder(ENCODER, loader=E.hashing_encoder())


def written(rows):
    """Vectors of whole numbers as text."""
    return rows.withColumn("embedding", F.concat_ws(",", F.transform("embedding", lambda x: x.cast("int").cast("string"))))


@query("encode", v.sql_with(v.DOCS, ENCODED) + "SELECT patent, year, embedding FROM encoded")
def encode(spark, sf):
    """E-5 with the hashing stand-in encoder."""
    return written(encoder().encode(v.docs(spark, sf)))


@query("encode_named", v.sql_with(v.DOCS, ENCODED.replace(ENCODER, "anferico/bert-for-patents")) + "SELECT patent, year, embedding FROM encoded")
def encode_named(spark, sf):
    """E-5 with another name, which gives other vectors."""
    return written(E.PretrainedEncoder("anferico/bert-for-patents", loader=E.hashing_encoder()).encode(v.docs(spark, sf)))


@query(
    "embed_pretrained",
    v.sql_with(v.DOCS, v.sql_windows(v.SLIDING), M, ENCODED)
    + "SELECT 'pre-encoder' AS model, \"window\", patent, m.year, embedding FROM members m JOIN encoded USING (patent)",
)
def embed_pretrained(spark, sf):
    """E-7, C-14: each document encoded once, then placed in its eleven windows."""
    rows = encoder().transform(corpus(spark, sf, v.SLIDING), "pre-encoder")
    return written(rows.select("model", "window", "patent", "year", "embedding"))


@query(
    "embed_new_only",
    v.sql_with(v.DOCS, ENCODED) + "SELECT patent, CASE WHEN patent % 3 = 0 THEN '1' ELSE embedding END AS embedding FROM encoded",
)
def embed_new_only(spark, sf):
    """C-14: a third of the documents has stored vectors of length one, the rest is encoded."""
    stored = v.doc_years(spark, sf).where("patent % 3 = 0").withColumn("embedding", F.array(F.lit(1.0)))
    return written(encoder().encode_new(v.docs(spark, sf), stored).select("patent", "embedding"))


SPARSE_SCORES = (
    'spans AS (SELECT "window", min(year) AS lo, max(year) AS hi FROM members GROUP BY 1), '
    'focal AS (SELECT "window", CAST((lo + hi) // 2 AS INTEGER) AS f, greatest((lo + hi) // 2 - lo, hi - (lo + hi) // 2) AS r FROM spans), '
    'lens AS (SELECT "window", patent, sqrt(sum(w * w)) AS len FROM vectors GROUP BY ALL), '
    'units AS (SELECT v."window", v.patent, term, w / len AS u FROM vectors v JOIN lens l ON l."window" = v."window" AND l.patent = v.patent), '
    'a AS (SELECT m."window", m.patent, f.f, f.r FROM members m JOIN focal f USING ("window") WHERE m.year = f.f), '
    'pairs AS (SELECT a."window", a.f, a.patent, b.patent AS other, b.year - a.f AS gap FROM a JOIN members b ON b."window" = a."window" '
    "AND abs(b.year - a.f) BETWEEN 1 AND a.r), "
    'dots AS (SELECT x."window", x.patent, y.patent AS other, sum(x.u * y.u) AS d FROM units x JOIN a ON a."window" = x."window" AND a.patent = x.patent '
    'JOIN units y ON y."window" = x."window" AND y.term = x.term GROUP BY ALL), '
    'sims AS (SELECT p.*, (1 + coalesce(d, 0)) / 2 AS s FROM pairs p LEFT JOIN dots d ON d."window" = p."window" AND d.patent = p.patent AND d.other = p.other), '
    'means AS (SELECT "window", f, patent, p, pow(avg(pow(s, p)) FILTER (gap < 0), 1 / p) AS back, pow(avg(pow(s, p)) FILTER (gap > 0), 1 / p) AS forward '
    'FROM sims, (SELECT unnest([1.0, 2.0]::DOUBLE[]) AS p) GROUP BY "window", f, patent, p) '
)


@query(
    "novelty_impact_sparse",
    v.sql_with(*BASE, tokens_sql(True), COUNTS, WINDOW_COUNTS, tfidf_sql("tfidf", "l1", False, 3, 1.0).rstrip() + ", " + SPARSE_SCORES)
    + "SELECT 'tfidf' AS model, \"window\", p AS exponent, f AS focal_year, patent, round(1 - back, 9) AS novelty, "
    "round(forward / (back + 1e-12), 9) AS impact FROM means",
)
def novelty_impact_sparse(spark, sf):
    """G-3 on TF-IDF vectors: term sums for exponent 1, blocks for exponent 2."""
    members = v.members(v.doc_years(spark, sf), v.EPOCHS)
    scores = S.novelty_impact_sparse(STOPPED.rows(corpus(spark, sf), "tfidf"), members, [1.0, 2.0])
    return v.rounded(scores, "novelty", "impact")
