"""Queries over windows and embedding scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scores as S, windows as W
from tidemark.functions import vectors as V
from tidemark.plans import views as v
from tidemark.plans.catalog import query

M = v.sql_members("docs")
VM = v.sql_members("vectors")
SLIDING = v.sql_windows(v.SLIDING)
EPOCHS = v.sql_windows(v.EPOCHS)
EXPONENTS = [1.0, 2.0, 3.0]


@query(
    "year_windows",
    'SELECT s || \'-\' || (s + 10) AS "window", CAST(s AS INTEGER) AS start, CAST(s + 10 AS INTEGER) AS "end", '
    "count(doc_id) AS docs FROM range(1900, 1915) t(s) LEFT JOIN documents ON 1900 + doc_id % 25 BETWEEN s AND s + 10 "
    "GROUP BY s",
)
def year_windows(spark, sf):
    """S-11, S-12 with the number of documents of each window."""
    frame = v.SLIDING.frame(spark)
    counts = v.members(v.doc_years(spark, sf), v.SLIDING).groupBy("window").agg(F.count("patent").alias("docs"))
    return frame.join(counts, "window", "left").select("window", "start", "end", F.coalesce("docs", F.lit(0)).alias("docs"))


@query("assign_windows", v.sql_with(v.DOCS, SLIDING, M) + "SELECT * FROM members")
def assign_windows(spark, sf):
    return v.members(v.doc_years(spark, sf), v.SLIDING)


@query(
    "docs_in_window",
    v.sql_with(v.DOCS, v.sql_windows(W.WindowSpec(1900, 1912, 11, 1)), M)
    + "SELECT patent, year, file, md5(contents) AS digest FROM docs WHERE patent IN (SELECT patent FROM members)",
)
def docs_in_window(spark, sf):
    docs = v.docs(spark, sf)
    members = v.members(v.doc_years(spark, sf), W.WindowSpec(1900, 1912, 11, 1))
    return W.docs_in_window(docs, members).select("patent", "year", "file", F.md5("contents").alias("digest"))


@query(
    "window_positions",
    v.sql_with(v.DOCS, SLIDING, M)
    + 'SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY year, patent) - 1 AS pos FROM members',
)
def window_positions(spark, sf):
    return W.window_positions(v.members(v.doc_years(spark, sf), v.SLIDING)).select("window", "patent", "year", "pos")


@query(
    "focal_year",
    v.sql_with(v.DOCS, EPOCHS, M, v.FOCAL)
    + 'SELECT "window", focal_year, CAST(1 AS INTEGER) AS w0, CAST(reach AS INTEGER) AS w1 FROM focal',
)
def focal_year(spark, sf):
    return W.focal_years(v.members(v.doc_years(spark, sf), v.EPOCHS))


SPLIT_FOCAL = (
    'SELECT m."window", m.patent, m.year, f.focal_year, CASE WHEN m.year = f.focal_year THEN \'focal\' '
    "WHEN m.year < f.focal_year THEN 'back' ELSE 'forward' END AS side FROM members m JOIN focal f USING (\"window\") "
    "WHERE m.year = f.focal_year OR abs(m.year - f.focal_year) BETWEEN {low} AND {high}"
)


@query("split_focal", v.sql_with(v.DOCS, SLIDING, M, v.FOCAL) + SPLIT_FOCAL.format(low=1, high="f.reach"))
def split_focal(spark, sf):
    return W.split_focal(v.members(v.doc_years(spark, sf), v.SLIDING)).select(
        "window", "patent", "year", "focal_year", "side"
    )


@query("split_focal_reach", v.sql_with(v.DOCS, SLIDING, M, v.FOCAL) + SPLIT_FOCAL.format(low=2, high=4))
def split_focal_reach(spark, sf):
    return W.split_focal(v.members(v.doc_years(spark, sf), v.SLIDING), (2, 4)).select(
        "window", "patent", "year", "focal_year", "side"
    )


@query(
    "window_year",
    'SELECT DISTINCT n AS "window", CASE WHEN n LIKE \'%-%-%\' THEN NULL WHEN n LIKE \'%-%\' THEN '
    "(try_cast(split_part(n, '-', 1) AS DOUBLE) + try_cast(split_part(n, '-', 2) AS DOUBLE)) / 2 "
    "ELSE try_cast(n AS DOUBLE) END AS year FROM (SELECT unnest([CAST(1900 + doc_id % 25 AS VARCHAR), "
    "(1900 + doc_id % 25) || '-' || (1910 + doc_id % 7), source, source || '-a-b']) AS n FROM documents)",
)
def window_year(spark, sf):
    y = 1900 + F.col("doc_id") % 25
    names = F.array(
        y.cast("string"), F.concat_ws("-", y, 1910 + F.col("doc_id") % 7), "source", F.concat("source", F.lit("-a-b"))
    )
    rows = v.table(spark, sf, "documents").select(F.explode(names).alias("window")).distinct()
    return rows.select("window", W.plot_year(F.col("window")).alias("year"))


HASH = "CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


@query(
    "sample_window",
    v.sql_with(v.DOCS, SLIDING, M)
    + 'SELECT "window", patent, year FROM members QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY '
    + HASH.format(text="\"window\" || '-' || patent || '-0'")
    + ") <= 20",
)
def sample_window(spark, sf):
    """P-1: twenty documents of each window by seeded hash."""
    return W.sample_window(v.members(v.doc_years(spark, sf), v.SLIDING), 20)


@query(
    "limit_per_file",
    v.sql_with(v.GAPS)
    + "SELECT patent, year FROM docs WHERE year <> 0 AND contents <> '' "
    "QUALIFY row_number() OVER (PARTITION BY year ORDER BY patent) <= 7",
)
def limit_per_file(spark, sf):
    """T-3: the first seven accepted documents of each year."""
    from tidemark.operators.clean import Preprocessor

    return Preprocessor().accepted(v.docs_with_gaps(spark, sf), 7).select("patent", "year")


# --- scores --------------------------------------------------------------------------------------

# similarity of every focal vector to every back or forward vector, and its power means
RANGE_JOIN = (
    'placed AS (SELECT m."window", u.patent, u.u, f.focal_year, m.year - f.focal_year AS gap, f.reach '
    'FROM members m JOIN focal f USING ("window") JOIN units u USING (patent)), '
    'pairs AS (SELECT a."window", a.focal_year, a.patent, b.gap, (1 + list_dot_product(a.u, b.u)) / 2 AS s '
    'FROM placed a JOIN placed b ON a."window" = b."window" AND a.gap = 0 AND b.gap <> 0 AND abs(b.gap) BETWEEN {low} AND {high}), '
    'means AS (SELECT "window", focal_year, patent, p AS exponent, '
    "pow(avg(pow(s, p)) FILTER (gap < 0), 1 / p) AS back, pow(avg(pow(s, p)) FILTER (gap > 0), 1 / p) AS forward "
    "FROM pairs, (SELECT unnest({exponents}::DOUBLE[]) AS p) GROUP BY \"window\", focal_year, patent, p), "
    "scores AS (SELECT 'vec' AS model, \"window\", exponent, focal_year, patent, 1 - back AS novelty, "
    "forward / (back + 1e-12) AS impact FROM means)"
)


def score_sql(exponents, select, low="1", high="a.reach"):
    body = RANGE_JOIN.format(low=low, high=high, exponents=str([float(p) for p in exponents]))
    return v.sql_with(v.VECTORS, v.UNITS, SLIDING, VM, v.FOCAL, body) + select


SCORE_ROWS = 'SELECT model, "window", exponent, focal_year, patent, round(novelty, 9) AS novelty, round(impact, 9) AS impact FROM scores'


def dense_scores(spark, sf, exponents, reach=None, method=None):
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    return S.novelty_impact(v.vectors(spark, sf), members, exponents, reach, dim=64, method=method)


@query("novelty_impact", score_sql(EXPONENTS, SCORE_ROWS))
def novelty_impact(spark, sf):
    """G-3 for exponents 1, 2, 3 from moment sums."""
    return v.rounded(dense_scores(spark, sf, EXPONENTS), "novelty", "impact")


def spread_sql(dim: int, parts: str) -> tuple[str, str]:
    """The vectors of 64 components as longer ones, and their units."""
    longer = f"vectors AS (SELECT * REPLACE (list_resize({parts}, {dim}) AS embedding) FROM short_vectors)"
    return v.VECTORS.replace("vectors AS", "short_vectors AS", 1), longer


def spread(vectors, dim: int, *parts):
    return vectors.withColumn("embedding", F.slice(F.concat(*parts), 1, dim))


def longer_sql(dim: int, exponents) -> str:
    parts = (
        "list_concat(list_concat(embedding, list_reverse(embedding)), list_concat(list_transform(embedding, lambda x: x * x), "
        "list_concat(list_transform(embedding, lambda x: x / 2), list_transform(list_reverse(embedding), lambda x: x * x * x))))"
    )
    body = RANGE_JOIN.format(low="1", high="a.reach", exponents=str([float(p) for p in exponents]))
    return v.sql_with(*spread_sql(dim, parts), v.UNITS, SLIDING, VM, v.FOCAL, body) + SCORE_ROWS


def longer_scores(spark, sf, dim, exponents, method=None):
    e = F.col("embedding")
    parts = [
        e, F.reverse(e), F.transform(e, lambda x: x * x), F.transform(e, lambda x: x / 2), F.transform(F.reverse(e), lambda x: x * x * x)
    ]
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    return S.novelty_impact(spread(v.vectors(spark, sf), dim, *parts), members, exponents, method=method)


@query("novelty_impact_128", longer_sql(128, [2, 3]))
def novelty_impact_128(spark, sf):
    """G-3 at 128 components: third moments in groups of slabs."""
    return v.rounded(longer_scores(spark, sf, 128, [2, 3], "moments"), "novelty", "impact")


@query("novelty_impact_300", longer_sql(300, [1, 2, 3]))
def novelty_impact_300(spark, sf):
    """G-3 at 300 components, by the way that takes less work for each exponent."""
    return v.rounded(longer_scores(spark, sf, 300, [1, 2, 3]), "novelty", "impact")


@query("power_mean", score_sql([0.5, 1.5], SCORE_ROWS))
def power_mean(spark, sf):
    """G-2 with exponents that have no moment form."""
    return v.rounded(dense_scores(spark, sf, [0.5, 1.5]), "novelty", "impact")


@query("focal_range_join", score_sql([1, 2], SCORE_ROWS, 2, 3))
def focal_range_join(spark, sf):
    """C-7 in blocks, with a reach of two to three years."""
    return v.rounded(dense_scores(spark, sf, [1, 2], (2, 3), "blocks"), "novelty", "impact")


WIDE_SQL = (
    "SELECT model, patent AS patent_ids, "
    + ", ".join(
        f'round(max({c}) FILTER (exponent = {p}), 9) AS "{c}-{p}"' for p in EXPONENTS for c in ("impact", "novelty")
    )
    + ' FROM scores GROUP BY model, patent, "window"'
)


@query("scores_wide", score_sql(EXPONENTS, WIDE_SQL))
def scores_wide(spark, sf):
    """J-6, J-7: the score table of a production run."""
    wide = S.scores_wide(dense_scores(spark, sf, EXPONENTS), EXPONENTS)
    numbers = [c for c in wide.columns if "-" in c]
    return wide.select("model", "patent_ids", *[F.round(f"`{c}`", 9).alias(c) for c in numbers])


@query("score_run", score_sql(EXPONENTS, SCORE_ROWS))
def score_run(spark, sf):
    """J-6 with vectors kept per window, as a fitted model leaves them."""
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    own = members.join(v.vectors(spark, sf).drop("year"), "patent")
    scores = S.novelty_impact(own, members, EXPONENTS, dim=64)
    return v.rounded(scores, "novelty", "impact")


@query("gather_scores", score_sql([1, 2], 'SELECT exponent, count(*) AS n, round(avg(novelty), 9) AS novelty FROM scores GROUP BY exponent'))
def gather_scores(spark, sf):
    """G-15: parts of several exponents are one long table."""
    scores = dense_scores(spark, sf, 1).unionByName(dense_scores(spark, sf, 2))
    return scores.groupBy("exponent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("novelty"), 9).alias("novelty"))


@query(
    "scores_cached",
    score_sql([1, 2], 'SELECT "window", exponent, patent, round(CASE WHEN substr("window", 4, 1) IN '
              "('0', '2', '4', '6', '8') AND exponent <= 2 THEN 0.5 ELSE novelty END, 9) AS novelty FROM scores"),
)
def scores_cached(spark, sf):
    """G-4: even windows are stored with both exponents, odd ones with the first only."""
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    vectors = v.vectors(spark, sf)
    focal = W.split_focal(members).where("side = 'focal'")
    even = F.substring("window", 4, 1).isin("0", "2", "4", "6", "8")
    stored = focal.select(
        F.lit("vec").alias("model"), "window", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("exponent"),
        "focal_year", "patent", F.lit(0.5).alias("novelty"), F.lit(1.0).alias("impact"),
    ).where(even | (F.col("exponent") == 1.0))
    requested = members.select(F.lit("vec").alias("model"), "window").distinct().withColumn(
        "exponent", F.explode(F.array(F.lit(1.0), F.lit(2.0)))
    )

    def compute(missing):
        return S.novelty_impact(vectors, members.join(missing, "window", "left_semi"), [1, 2], dim=64)

    out = S.scores_cached(requested, stored, compute)
    return v.rounded(out.select("window", "exponent", "patent", "novelty"), "novelty")


LAG_SQL = (
    'placed AS (SELECT m."window", u.u, row_number() OVER (PARTITION BY m."window" ORDER BY m.year, patent) - 1 AS pos, '
    'count(*) OVER (PARTITION BY m."window") AS n FROM members m JOIN units u USING (patent)), '
    "deltas AS (SELECT DISTINCT CAST(floor(1.5 + 0.3 * k * k) AS BIGINT) AS delta FROM range(5000) t(k)), "
    'lags AS (SELECT a."window", d.delta, a.n, list_dot_product(a.u, b.u) AS s FROM placed a JOIN deltas d ON d.delta < a.n '
    'JOIN placed b ON b."window" = a."window" AND b.pos = a.pos + d.delta) '
)


@query(
    "autocorrelation",
    v.sql_with(v.VECTORS, v.UNITS, SLIDING, VM, LAG_SQL)
    + "SELECT 'vec' AS model, \"window\", delta, round(4.0 * delta / n, 9) AS delta_year, "
    'round(avg(s), 9) AS autocorrelation FROM lags GROUP BY "window", delta, n',
)
def autocorrelation(spark, sf):
    """G-10, C-12."""
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    own = members.select("window", "patent").join(v.vectors(spark, sf).drop("year"), "patent")
    return v.rounded(S.autocorrelation(own, members), "delta_year", "autocorrelation")


@query(
    "window_difference_points",
    v.sql_with(v.VECTORS, v.UNITS, SLIDING, VM, v.FOCAL)
    + 'SELECT model, "window", patent, round(a, 9) AS first, round(b, 9) AS second FROM '
    "(SELECT 'vec' AS model, p.\"window\", p.patent, "
    '1 - avg(s) FILTER (gap < 0 AND gap >= -2) AS a, 1 - avg(s) FILTER (gap <= -3 AND gap >= -5) AS b '
    'FROM (SELECT x."window", x.patent, y.gap, (1 + list_dot_product(x.u, y.u)) / 2 AS s FROM '
    '(SELECT m."window", patent, u.u FROM members m JOIN focal f USING ("window") JOIN units u USING (patent) '
    'WHERE m.year = f.focal_year) x JOIN (SELECT m."window", u.u, m.year - f.focal_year AS gap FROM members m '
    'JOIN focal f USING ("window") JOIN units u USING (patent)) y USING ("window")) p GROUP BY ALL)',
)
def window_difference_points(spark, sf):
    """C-15: novelty of the same document under a near and a far reach."""
    from tidemark.operators.grading import paired_scores

    near = dense_scores(spark, sf, 1, (1, 2))
    far = dense_scores(spark, sf, 1, (3, 5))
    return v.rounded(paired_scores(near, far, "novelty"), "first", "second")


@query(
    "dot_product",
    v.sql_with(v.VECTORS)
    + "SELECT a.patent, round(list_dot_product(a.embedding, b.embedding), 6) AS dot, "
    "round(sqrt(list_dot_product(a.embedding, a.embedding)), 6) AS len FROM vectors a JOIN vectors b ON b.patent = a.patent + 1",
)
def dot_product(spark, sf):
    """S-1, S-2 over neighbouring ids."""
    a = v.vectors(spark, sf)
    b = a.select((F.col("patent") - 1).alias("patent"), F.col("embedding").alias("other"))
    return a.join(b, "patent").select(
        "patent", F.round(V.dot(F.col("embedding"), F.col("other")), 6).alias("dot"),
        F.round(V.norm(F.col("embedding")), 6).alias("len"),
    )
