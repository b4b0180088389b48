"""Queries over classification codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codes as CF
from tidemark.operators import codes as C
from tidemark.operators.windows import WindowSpec
from tidemark.plans import views as v
from tidemark.plans.catalog import query

M = v.sql_members("docs")
SLIDING = v.sql_windows(v.SLIDING)
CODES = v.sql_with(v.CODES)


@query("codes_with_year", v.sql_with(v.CODES, v.CODE_YEARS) + "SELECT * FROM codes JOIN years USING (pat)")
def codes_with_year(spark, sf):
    return C.codes_with_year(v.codes(spark, sf), v.code_years(spark, sf))


@query(
    "sorted_codes",
    v.sql_with(v.CODES, v.CODE_YEARS) + "SELECT pat, progr, CPC, year FROM codes JOIN years USING (pat) ORDER BY year, pat, progr",
)
def sorted_codes(spark, sf):
    """T-2."""
    return C.sorted_codes(v.codes(spark, sf), v.code_years(spark, sf))


@query(
    "code_vectors",
    v.sql_with(v.CODES, v.CODE_YEARS, v.LEVELS)
    + "SELECT pat, year, progr, ascii(l1) AS l1, CAST(l2 AS INTEGER) AS l2, CAST(l3 AS INTEGER) AS l3, ascii(l4) AS l4, "
    "CAST(l5 AS INTEGER) AS l5, CAST(l6 AS INTEGER) AS l6 FROM levels JOIN years USING (pat)",
)
def code_vectors(spark, sf):
    """C-16, S-9."""
    rows = C.code_vectors(v.codes(spark, sf), v.code_years(spark, sf))
    return rows.select("pat", "year", "progr", *[F.get("levels", i).cast("int").alias(f"l{i + 1}") for i in range(6)])


@query(
    "codes_for_docs",
    v.sql_with(v.CODES, v.GAPS) + "SELECT * FROM codes WHERE pat IN (SELECT patent FROM docs WHERE year <> 0 AND contents <> '')",
)
def codes_for_docs(spark, sf):
    from tidemark.operators.clean import Preprocessor

    return C.codes_for_docs(v.codes(spark, sf), Preprocessor().accepted(v.docs_with_gaps(spark, sf)))


@query("codes_per_doc", CODES + "SELECT pat, string_agg(CPC, ';' ORDER BY progr) AS codes FROM codes GROUP BY pat")
def codes_per_doc(spark, sf):
    lists = C.codes_per_doc(v.codes(spark, sf))
    return lists.select("pat", F.array_join("CPC", ";").alias("codes"))


# mean of the best matches of either side's codes, for a table pairs(g, i, j)
SIMILAR = (
    f"cross_codes AS (SELECT p.g, p.i, p.j, a.progr AS pi, b.progr AS pj, {v.agreeing_levels('a', 'b')} AS k "
    "FROM pairs p JOIN levels a ON a.pat = p.i JOIN levels b ON b.pat = p.j), "
    f"sims AS (SELECT g, i, j, pi, pj, {v.similarity_levels()} AS s FROM cross_codes), "
    "best AS (SELECT g, i, j, max(s) AS s FROM sims GROUP BY g, i, j, pi UNION ALL "
    "SELECT g, i, j, max(s) FROM sims GROUP BY g, i, j, pj), "
    "similar_pairs AS (SELECT g, i, j, CASE WHEN i = j THEN 1.0 ELSE avg(s) END AS correlation FROM best GROUP BY g, i, j)"
)


@query(
    "code_similarity",
    v.sql_with(
        v.CODES, v.LEVELS,
        "pairs AS (SELECT 0 AS g, doc_id AS i, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS j FROM documents)",
        SIMILAR,
    )
    + "SELECT i, j, round(correlation, 9) AS correlation FROM similar_pairs",
)
def code_similarity(spark, sf):
    """G-5, C-10, S-8 for one partner of every document."""
    rows = v.table(spark, sf, "documents")
    n = rows.agg(F.count(F.lit(1))).scalar()
    pairs = rows.select(F.col("doc_id").alias("i"), ((F.col("doc_id") * 7 + 3) % n).alias("j"))
    return v.rounded(C.pair_code_similarity(pairs, v.codes(spark, sf)), "correlation")


@query(
    "code_cross",
    v.sql_with(v.CODES, v.LEVELS)
    + f"SELECT i, ci, cj, round({v.similarity_levels()}, 9) AS similarity FROM (SELECT a.pat AS i, a.CPC AS ci, b.CPC AS cj, "
    f"{v.agreeing_levels('a', 'b')} AS k FROM levels a JOIN levels b ON b.pat = a.pat + 1)",
)
def code_cross(spark, sf):
    """C-10, S-8, S-10: every code of a document against every code of the next one."""
    codes = v.codes(spark, sf)
    a = codes.select(F.col("pat").alias("i"), F.col("CPC").alias("ci"))
    b = codes.select((F.col("pat") - 1).alias("i"), F.col("CPC").alias("cj"))
    similarity = CF.code_similarity(CF.text_levels(F.col("ci")), CF.text_levels(F.col("cj")))
    return a.join(b, "i").select("i", "ci", "cj", F.round(similarity, 9).alias("similarity"))


def sampled(group: str, k: int, seed: str) -> str:
    """SQL of the systematic pair sample of ``placed(g, patent)``."""
    start = f"CAST('0x' || substr(md5(patent || '-' || {seed}), 1, 15) AS BIGINT)"
    return (
        f"ranked AS (SELECT {group} AS g, patent, row_number() OVER (PARTITION BY {group} ORDER BY patent) - 1 AS pos, "
        f"count(*) OVER (PARTITION BY {group}) AS n FROM placed), "
        f"offs AS (SELECT g, patent, pos, n, CASE WHEN n - 1 <= {k} THEN m + 1 ELSE "
        f"({start} % (n - 1) + m * greatest((n - 1) // {k}, 1)) % (n - 1) + 1 END AS off "
        f"FROM ranked, range({k}) t(m) WHERE n > 1 AND (n - 1 > {k} OR m + 1 <= n - 1)), "
        "pairs AS (SELECT o.g, o.patent AS i, r.patent AS j FROM offs o JOIN ranked r ON r.g = o.g "
        f"AND r.pos = (o.pos + o.off) % o.n WHERE o.n - 1 > {k} OR o.pos < r.pos)"
    )


SEED = "CAST(round_even((CAST(split_part(g, '-', 1) AS INTEGER) + CAST(split_part(g, '-', 2) AS INTEGER)) / 2, 0) AS INTEGER)"


@query(
    "window_pairs",
    v.sql_with(v.DOCS, v.CODES, v.LEVELS, SLIDING, M, "placed AS (SELECT * FROM members)", sampled('"window"', 10, SEED), SIMILAR)
    + 'SELECT g AS "window", i, j, round(correlation, 9) AS correlation FROM similar_pairs',
)
def window_pairs(spark, sf):
    """P-2b: ten partners of every document of every window."""
    pairs = C.window_pairs(v.members(v.doc_years(spark, sf), v.SLIDING), v.codes(spark, sf), 10)
    return v.rounded(pairs, "correlation")


@query(
    "sample_pairs",
    v.sql_with(v.DOCS, "placed AS (SELECT file, patent FROM docs)", sampled("file", 4, "7"))
    + "SELECT g AS file, i, j FROM pairs",
)
def sample_pairs(spark, sf):
    """P-2 with a seed, four partners within each source."""
    rows = v.table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("patent"))
    return C.sample_pairs(rows, ["file"], 4, 7)


@query(
    "all_pairs",
    v.sql_with(
        v.DOCS, "placed AS (SELECT year || lang || source AS y, doc_id AS patent FROM docs JOIN documents ON doc_id = patent)",
        sampled("y", 60, "0"),
    )
    + "SELECT g AS y, i, j FROM pairs",
)
def all_pairs(spark, sf):
    """C-9: a group of at most k + 1 documents gives all its pairs i < j."""
    rows = v.table(spark, sf, "documents").select(
        F.concat(v.year("doc_id").cast("string"), "lang", "source").alias("y"), F.col("doc_id").alias("patent")
    )
    return C.sample_pairs(rows, ["y"], 60, 0)


@query(
    "pairs_small_and_large",
    v.sql_with(
        "placed AS (SELECT CASE WHEN doc_id < 30 THEN 'small' || doc_id % 3 ELSE lang END AS y, doc_id AS patent FROM documents)",
        sampled("y", 12, "0"),
    )
    + "SELECT g AS y, i, j FROM pairs",
)
def pairs_small_and_large(spark, sf):
    """P-2, C-9 at any size of the tables: groups of ten give all their pairs, large groups twelve partners of each document."""
    small = F.concat(F.lit("small"), (F.col("doc_id") % 3).cast("string"))
    rows = v.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") < 30, small).otherwise(F.col("lang")).alias("y"), F.col("doc_id").alias("patent")
    )
    return C.sample_pairs(rows, ["y"], 12, 0)


@query(
    "year_pairs",
    v.sql_with(v.DOCS, v.CODES, v.LEVELS, "placed AS (SELECT * FROM docs)", sampled("year", 10, "12345"), SIMILAR)
    + "SELECT CAST(g AS INTEGER) AS year, i, j, round(correlation, 9) AS correlation FROM similar_pairs",
)
def year_pairs(spark, sf):
    """J-1: pairs that stay within a year."""
    return v.rounded(C.year_pairs(v.doc_years(spark, sf), v.codes(spark, sf)), "correlation")


def code_score_sql(exponents, back="true", codes=v.CODES):
    listed = str([float(p) for p in exponents])
    return (
        v.sql_with(
            codes, v.LEVELS, v.CODE_YEARS, SLIDING,
            f'focal AS (SELECT "window", (start + "end") // 2 AS f, "end" FROM windows)',
            # distinct codes stand for all documents that hold them, per year
            "coded AS (SELECT l.*, y.year FROM levels l JOIN years y USING (pat))",
            "vocabulary AS (SELECT DISTINCT CPC, l1, l2, l3, l4, l5, l6 FROM levels)",
            f"near AS (SELECT a.CPC AS ca, b.CPC AS cb, {v.agreeing_levels('a', 'b')} AS k FROM vocabulary a JOIN vocabulary b ON a.l1 = b.l1)",
            f"close_codes AS (SELECT ca, cb, {v.similarity_levels()} AS s FROM near)",
            'best AS (SELECT w."window", w.f, a.pat, a.progr, o.pat AS other, o.year AS oy, max(c.s) AS s FROM focal w '
            "JOIN coded a ON a.year = w.f JOIN close_codes c ON c.ca = a.CPC JOIN coded o ON o.CPC = c.cb "
            f'AND (o.year < w.f AND {back} OR o.year > w.f AND o.year <= w."end") GROUP BY ALL)',
            "lens AS (SELECT pat, count(*) AS m FROM codes GROUP BY pat)",
            'means AS (SELECT b."window", b.f, b.pat, b.oy < b.f AS is_back, sum(s) / any_value(m) AS x '
            'FROM best b JOIN lens USING (pat) GROUP BY b."window", b.f, b.pat, b.other, b.oy)',
            'sizes AS (SELECT w."window", count(*) FILTER (o.year < w.f AND ' + back + ') AS nb, '
            'count(*) FILTER (o.year > w.f) AS nf FROM focal w JOIN (SELECT DISTINCT pat, year FROM coded) o ON o.year <= w."end" GROUP BY 1)',
            'sums AS (SELECT "window", f, pat, p, coalesce(sum(pow(x, p)) FILTER (is_back), 0) AS sb, '
            f"coalesce(sum(pow(x, p)) FILTER (NOT is_back), 0) AS sf FROM means, (SELECT unnest({listed}::DOUBLE[]) AS p) GROUP BY ALL)",
            'final AS (SELECT "window", p AS exponent, CAST(f AS INTEGER) AS focal_year, pat AS patent, pow(sb / nb, 1 / p) AS back, '
            'pow(sf / nf, 1 / p) AS forward FROM sums JOIN sizes USING ("window"))',
        )
        + 'SELECT "window", exponent, focal_year, patent, round(back, 9) AS back_similarity, round(1 - back, 9) AS novelty, '
        "round(forward / (back + 1e-12), 9) AS impact FROM final"
    )


def code_scores(spark, sf, exponents, codes=v.codes, **options):
    vectors = C.code_vectors(codes(spark, sf), v.code_years(spark, sf))
    scores = C.code_novelty_impact(vectors, v.SLIDING.frame(spark), exponents, **options)
    return v.rounded(scores, "back_similarity", "novelty", "impact")


@query("code_novelty_impact", code_score_sql([1]))
def code_novelty_impact(spark, sf):
    """G-6, back range = all earlier years."""
    return code_scores(spark, sf, 1.0)


@query("code_novelty_impact_powers", code_score_sql([1, 2, 3]))
def code_novelty_impact_powers(spark, sf):
    """G-6 with several exponents from counts of prefix sets."""
    return code_scores(spark, sf, [1, 2, 3])


@query("code_focal_join", code_score_sql([1.5], "o.year >= w.f - 5"))
def code_focal_join(spark, sf):
    """C-11 in blocks: an exponent without a counting form, back range of five years."""
    return code_scores(spark, sf, [1.5], back_years=5)


# --- lists of 0 to 30 codes ----------------------------------------------------------------------


@query("code_novelty_impact_wide", code_score_sql([1, 2, 3], codes=v.WIDE_CODES))
def code_novelty_impact_wide(spark, sf):
    """G-6 from counts of prefix sets; documents without codes have no row."""
    return code_scores(spark, sf, [1, 2, 3], v.wide_codes)


@query("code_focal_join_wide", code_score_sql([1.5], "o.year >= w.f - 5", v.WIDE_CODES))
def code_focal_join_wide(spark, sf):
    """C-11 in blocks that are bounded in code rows."""
    return code_scores(spark, sf, [1.5], v.wide_codes, back_years=5)


@query(
    "code_similarity_wide",
    v.sql_with(
        v.WIDE_CODES, v.LEVELS,
        "pairs AS (SELECT 0 AS g, doc_id AS i, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS j FROM documents)",
        SIMILAR,
    )
    + "SELECT i, j, round(CASE WHEN i = j THEN 1.0 ELSE correlation END, 9) AS correlation FROM pairs LEFT JOIN similar_pairs USING (g, i, j)",
)
def code_similarity_wide(spark, sf):
    """G-5; NULL if one of two documents has no codes."""
    rows = v.table(spark, sf, "documents")
    n = rows.agg(F.count(F.lit(1))).scalar()
    pairs = rows.select(F.col("doc_id").alias("i"), ((F.col("doc_id") * 7 + 3) % n).alias("j"))
    return v.rounded(C.pair_code_similarity(pairs, v.wide_codes(spark, sf)), "correlation")


@query(
    "window_pairs_wide",
    v.sql_with(
        v.DOCS, v.WIDE_CODES, v.LEVELS, SLIDING, M, "placed AS (SELECT * FROM members WHERE patent IN (SELECT pat FROM codes))",
        sampled('"window"', 10, SEED), SIMILAR,
    )
    + 'SELECT g AS "window", i, j, round(correlation, 9) AS correlation FROM similar_pairs',
)
def window_pairs_wide(spark, sf):
    """P-2b; documents without codes are in no pair."""
    pairs = C.window_pairs(v.members(v.doc_years(spark, sf), v.SLIDING), v.wide_codes(spark, sf), 10)
    return v.rounded(pairs, "correlation")
