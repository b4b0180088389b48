"""Queries over grades of models and over tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import codes as C, grading as G, sweep as SW
from tidemark.plans import runs, views as v
from tidemark.plans.catalog import query
from tidemark.plans.code_queries import SEED, SIMILAR, sampled
from tidemark.plans.score_queries import dense_scores
from tidemark.plans.vector_queries import BASE, COUNTS, STOPPED, WINDOW_COUNTS, corpus, tfidf_sql, tokens_sql

VM = v.sql_members("vectors")
CODED = "placed AS (SELECT * FROM members WHERE patent IN (SELECT pat FROM codes))"
DENSE = (
    v.VECTORS, v.CODES, v.LEVELS, v.sql_windows(v.SLIDING), VM, CODED, sampled('"window"', 10, SEED), SIMILAR,
    "similarities AS (SELECT 'vec' AS model, g AS \"window\", i, j, correlation, "
    "round(list_dot_product(a.embedding, b.embedding), 6) AS similarity FROM similar_pairs "
    "JOIN vectors a ON a.patent = i JOIN vectors b ON b.patent = j)",
)
SPARSE = (
    *BASE, v.CODES, v.LEVELS, tokens_sql(True).replace("placed AS", "spots AS").replace("FROM placed", "FROM spots"), COUNTS,
    WINDOW_COUNTS, tfidf_sql("tfidf", "l1", False, 3, 1.0).rstrip(), CODED, sampled('"window"', 10, SEED), SIMILAR,
    'dots AS (SELECT p.g, p.i, p.j, sum(a.w * b.w) AS s FROM pairs p JOIN vectors a ON a."window" = p.g AND a.patent = p.i '
    'JOIN vectors b ON b."window" = p.g AND b.patent = p.j AND b.term = a.term GROUP BY ALL)',
    "similarities AS (SELECT 'tfidf' AS model, g AS \"window\", i, j, correlation, round(coalesce(s, 0), 12) AS similarity "
    "FROM similar_pairs LEFT JOIN dots USING (g, i, j))",
)
PAIR_ROWS = 'SELECT model, "window", i, j, round(correlation, 9) AS correlation, similarity FROM similarities'


def ranks_sql(source: str, group: str, x: str, y: str) -> str:
    def rank(c):
        return (
            f"rank() OVER (PARTITION BY {group} ORDER BY {c}) + "
            f"(count(*) OVER (PARTITION BY {group}, {c}) - 1) / 2.0"
        )

    return f"ranked AS (SELECT {group}, {rank(x)} AS rx, {rank(y)} AS ry FROM {source})"


GRADES = (
    'corrs AS (SELECT model, "window", round(corr(rx, ry), 9) AS spearman FROM ranked GROUP BY ALL), '
    'grades AS (SELECT model, "window", (CAST(split_part("window", \'-\', 1) AS DOUBLE) + '
    'CAST(split_part("window", \'-\', 2) AS DOUBLE)) / 2 AS year, spearman FROM corrs) '
)


def grades_sql(parts, select):
    ranks = ranks_sql("similarities", 'model, "window"', "similarity", "round(correlation, 9)")
    ranks = ranks.replace("ranked AS", "ranked_pairs AS")
    return v.sql_with(*parts, ranks, GRADES.replace("FROM ranked", "FROM ranked_pairs")) + select


def dense_similarities(spark, sf):
    pairs = C.window_pairs(v.members(v.vector_years(spark, sf), v.SLIDING), v.codes(spark, sf), 10)
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    own = members.select("window", "patent").join(v.vectors(spark, sf), "patent")
    rows = G.pair_similarity(pairs, own).withColumn("similarity", F.round("similarity", 6))
    return v.rounded(rows, "correlation")


def sparse_similarities(spark, sf):
    pairs = C.window_pairs(v.members(v.doc_years(spark, sf), v.EPOCHS), v.codes(spark, sf), 10, cells=True)
    rows = G.pair_similarity_sparse(pairs, STOPPED.rows(corpus(spark, sf), "tfidf"))
    return v.rounded(rows.withColumn("similarity", F.round("similarity", 12)), "correlation")


@query("pair_similarity", v.sql_with(*DENSE) + PAIR_ROWS)
def pair_similarity(spark, sf):
    """C-8 for dense vectors."""
    return dense_similarities(spark, sf)


@query("pair_similarity_sparse", v.sql_with(*SPARSE) + PAIR_ROWS)
def pair_similarity_sparse(spark, sf):
    """C-8 for TF-IDF vectors."""
    return sparse_similarities(spark, sf)


@query(
    "spearman",
    v.sql_with(
        "rows AS (SELECT d.lang, d.n_chars AS x, l.quality + l.toxic AS y FROM documents d JOIN labels l USING (doc_id))",
        ranks_sql("rows", "lang", "x", "y"),
    )
    + "SELECT lang, round(corr(rx, ry), 9) AS spearman FROM ranked GROUP BY lang",
)
def spearman(spark, sf):
    """G-7, W-3 between text length and a two-valued label, full of ties."""
    rows = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    rows = rows.select("lang", F.col("n_chars").alias("x"), (F.col("quality") + F.col("toxic")).alias("y"))
    return v.rounded(G.spearman(rows, ["lang"], "x", "y"), "spearman")


@query("grade_models", grades_sql(DENSE, "SELECT * FROM grades"))
def grade_models(spark, sf):
    """G-8."""
    return v.rounded(G.model_grades(dense_similarities(spark, sf)), "spearman")


@query("grade_models_sparse", grades_sql(SPARSE, "SELECT * FROM grades"))
def grade_models_sparse(spark, sf):
    """G-8 for TF-IDF."""
    return v.rounded(G.model_grades(sparse_similarities(spark, sf)), "spearman")


@query("mean_grade", grades_sql(DENSE, "SELECT model, round(avg(spearman), 8) AS mean_spearman, round(-avg(spearman), 8) AS loss, count(*) - count(spearman) AS ungraded FROM grades GROUP BY model"))
def mean_grade(spark, sf):
    """G-9."""
    grades = G.mean_grade(v.rounded(G.model_grades(dense_similarities(spark, sf)), "spearman"))
    return v.rounded(grades, "mean_spearman", "loss", digits=8)


@query("grade_series", grades_sql(DENSE, "SELECT model, year, spearman FROM grades WHERE model = 'vec' ORDER BY model, year"))
def grade_series(spark, sf):
    """J-8, B-8."""
    grades = G.filter_models(G.model_grades(dense_similarities(spark, sf)), "vec")
    return v.rounded(runs.grade_series(grades), "spearman")


POINTS = (
    v.VECTORS, v.UNITS, v.sql_windows(v.SLIDING), VM, v.FOCAL,
    'points AS (SELECT p."window", p.patent, round(1 - avg(s) FILTER (gap BETWEEN -2 AND -1), 9) AS a, '
    'round(1 - avg(s) FILTER (gap BETWEEN -5 AND -3), 9) AS b FROM (SELECT x."window", x.patent, y.gap, '
    "(1 + list_dot_product(x.u, y.u)) / 2 AS s FROM (SELECT m.\"window\", patent, u.u FROM members m "
    'JOIN focal f USING ("window") JOIN units u USING (patent) WHERE m.year = f.focal_year) x JOIN '
    '(SELECT m."window", u.u, m.year - f.focal_year AS gap FROM members m JOIN focal f USING ("window") '
    'JOIN units u USING (patent)) y USING ("window")) p GROUP BY ALL)',
)


def near_and_far(spark, sf):
    near, far = (v.rounded(dense_scores(spark, sf, 1, r), "novelty") for r in ((1, 2), (3, 5)))
    return near, far


@query(
    "window_difference",
    v.sql_with(*POINTS, "labelled AS (SELECT 'vec' AS model, a, b FROM points)", ranks_sql("labelled", "model", "a", "b"))
    + "SELECT model, round(corr(rx, ry), 9) AS spearman FROM ranked GROUP BY model",
)
def window_difference(spark, sf):
    """C-15."""
    return v.rounded(G.window_difference(*near_and_far(spark, sf)), "spearman")


@query(
    "sample_display",
    v.sql_with(*POINTS)
    + "SELECT 'vec' AS model, \"window\", patent, a AS first, b AS second FROM points QUALIFY row_number() OVER (ORDER BY "
    "CAST('0x' || substr(md5(\"window\" || '-' || patent || '-0'), 1, 15) AS BIGINT)) <= 100",
)
def sample_display(spark, sf):
    """P-3: a hundred points for display."""
    return G.sample_points(G.paired_scores(*near_and_far(spark, sf), "novelty"), 100)


# --- tuning --------------------------------------------------------------------------------------


@query(
    "tuning_data",
    v.sql_with(
        v.GAPS, v.CODES, v.LEVELS, v.sql_windows(v.EPOCHS),
        "placed AS (SELECT * FROM docs WHERE year <> 0 AND contents <> '')", sampled("year", 10, "12345"), SIMILAR,
    )
    + 'SELECT w."window", i, j, round(correlation, 9) AS correlation FROM similar_pairs '
    'JOIN windows w ON g BETWEEN w.start AND w."end"',
)
def tuning_data(spark, sf):
    """J-1: pairs within years, gathered by window."""
    _, pairs = SW.tuning_data(v.docs_with_gaps(spark, sf), v.codes(spark, sf), v.EPOCHS.frame(spark))
    return v.rounded(pairs, "correlation")


def tuning(spark, sf):
    windows = v.EPOCHS.frame(spark)
    cleaned, pairs = SW.tuning_data(v.docs(spark, sf), v.codes(spark, sf), windows, cells=True)
    return cleaned, pairs, windows


def flat_trials(trials):
    return trials.select("label", SW.params_key().alias("params"), "loss")


TRIALS = "trials AS (SELECT lang AS label, 'source=' || source AS params, round(-avg(n_chars), 6) AS loss FROM documents GROUP BY ALL)"


def trials(spark, sf):
    """One trial per language and source: its loss is the mean text length, negated."""
    rows = v.table(spark, sf, "documents").groupBy("lang", "source").agg(F.round(-F.avg("n_chars"), 6).alias("loss"))
    return rows.select(F.col("lang").alias("label"), F.create_map(F.lit("source"), "source").alias("params"), "loss")


@query("best_trial", v.sql_with(TRIALS) + "SELECT label, min_by(params, loss) AS params, min(loss) AS loss FROM trials GROUP BY label")
def best_trial(spark, sf):
    """T-4."""
    return flat_trials(SW.best_trial(trials(spark, sf)))


@query("ranked_trials", v.sql_with(TRIALS) + "SELECT * FROM trials WHERE label = 'en' ORDER BY loss LIMIT 5")
def ranked_trials(spark, sf):
    """T-4: the five best trials of a label."""
    return flat_trials(SW.ranked_trials(trials(spark, sf), "en", 5))


@query(
    "pending_trials",
    v.sql_with(TRIALS) + "SELECT * FROM trials WHERE (label, params) NOT IN "
    "(SELECT lang, 'source=' || source FROM documents WHERE n_chars > 8000)",
)
def pending_trials(spark, sf):
    """J-4, J-5: a long text of the same language and source finishes a trial."""
    long = v.table(spark, sf, "documents").where("n_chars > 8000")
    done = long.select(F.col("lang").alias("label"), F.create_map(F.lit("source"), "source").alias("params"))
    return flat_trials(SW.pending_trials(trials(spark, sf), done))
