"""Queries that write what they derive from the tables to the shared folder, and read it back."""

from __future__ import annotations

import json
import lzma

import pandas as pd
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import embed as E
from tidemark.operators.clean import Preprocessor
from tidemark.operators.scores import scores_wide
from tidemark.plans import views as v
from tidemark.plans.catalog import query
from tidemark.plans.score_queries import WIDE_SQL, dense_scores, score_sql
from tidemark.plans.text_queries import clean_sql, remains_sql, unprintable
from tidemark.plans.vector_queries import countvec_sql
from tidemark.session import scratch_path
from tidemark.sources import documents as D, store as ST, tables as TB
from tidemark.streaming.ingest import ingest_dir

S = v.SPACE_CLASS
HEAD = "/Volumes/External/txt/0000000-0100000/US"


# --- raw bundles ---------------------------------------------------------------------------------

BUNDLE = (
    r"latin AS (SELECT doc_id, regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') AS t FROM documents), "
    f"parsed AS (SELECT doc_id AS patent, '{HEAD}' || doc_id || '.txt' AS file, "
    f"trim(regexp_replace(regexp_replace(' ' || t, '[\\r\\n]+', '', 'g'), '[{S}]+', ' ', 'g')) AS contents FROM latin)"
)


def write_bundle(spark, sf):
    """Documents as latin-1 bundles: a header line with the first line of text, then the other lines."""
    text = F.regexp_replace("contents", r"[^\x00-\xff]", "?")
    whole = F.concat(F.lit(HEAD), F.col("patent").cast("string"), F.lit(".txt "), text)
    path = scratch_path(spark, "bundle")
    rows = v.docs(spark, sf).select(F.encode(whole, "ISO-8859-1").cast("string").alias("value"))
    rows.write.text(path)
    return path


@query(
    "read_raw_bundle",
    v.sql_with(BUNDLE) + "SELECT patent, file, md5(contents) AS digest, length(contents) AS chars FROM parsed",
)
def read_raw_bundle(spark, sf):
    """A-1."""
    docs = D.read_raw_bundle(spark, write_bundle(spark, sf))
    return docs.select("patent", "file", F.md5("contents").alias("digest"), F.length("contents").alias("chars"))


@query(
    "ingest_dir",
    v.sql_with(BUNDLE)
    + "SELECT patent, CAST(CASE WHEN patent % 5 = 0 THEN NULL ELSE 1900 + patent % 25 END AS INTEGER) AS year, "
    "md5(contents) AS digest FROM parsed",
)
def ingest_stream(spark, sf):
    """A-11: a stream over the bundles; every fifth document has no known year. The second run adds nothing."""
    raw, out, checkpoint = write_bundle(spark, sf), scratch_path(spark, "by-year"), scratch_path(spark, "offsets")
    years = v.code_years(spark, sf).where("pat % 5 <> 0")
    for _ in range(2):
        ingest_dir(spark, raw, years, out, checkpoint)
    return D.read_by_year(spark, out).select("patent", "year", F.md5("contents").alias("digest"))


@query(
    "join_year",
    "SELECT doc_id AS patent, CAST(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1900 + doc_id % 25 END AS INTEGER) AS year FROM documents",
)
def join_year(spark, sf):
    """C-1."""
    years = v.code_years(spark, sf).where("pat % 5 <> 0")
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("patent"))
    return D.join_year(docs, years)


# --- document files ------------------------------------------------------------------------------

DOC_ROWS = "SELECT patent, year, file, md5(contents) AS digest FROM docs"


def doc_rows(rows):
    return rows.select("patent", "year", "file", F.md5("contents").alias("digest"))


@query("read_jsonl", v.sql_with(v.DOCS) + DOC_ROWS)
def read_jsonl(spark, sf):
    """A-3, S-13."""
    path = scratch_path(spark, "jsonl")
    v.docs(spark, sf).write.json(path)
    return doc_rows(D.read_jsonl(spark, path, pattern="*.json"))


@query("read_year_xz", v.sql_with(v.DOCS) + DOC_ROWS)
def read_year_xz(spark, sf):
    """A-2: each batch of documents becomes one compressed array, which is decoded again."""

    def pack(batches):
        for batch in batches:
            if len(batch):
                text = json.dumps(batch.to_dict("records"))
                yield pd.DataFrame({"content": [lzma.compress(text.encode("utf-8"), preset=0)]})

    packed = v.docs(spark, sf).mapInPandas(pack, "content binary")
    return doc_rows(D.decode_year_files(packed))


@query("write_by_year", v.sql_with(v.DOCS) + DOC_ROWS)
def write_by_year(spark, sf):
    """A-9, T-1."""
    path = scratch_path(spark, "by-year")
    D.write_by_year(v.docs(spark, sf), path)
    return doc_rows(D.read_by_year(spark, path))


@query(
    "append_new_docs",
    v.sql_with(
        v.DOCS,
        "batch AS (SELECT patent, year, CASE WHEN patent % 5 = 1 THEN NULL ELSE file END AS file, contents FROM docs "
        "UNION ALL SELECT patent, year, CASE WHEN patent % 4 = 0 THEN NULL ELSE file END, '!' || contents FROM docs WHERE patent % 7 < 2)",
        "firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY patent, year ORDER BY file IS NULL, file, contents) = 1)",
    )
    + "SELECT patent, year, CASE WHEN patent % 3 = 0 THEN docs.file ELSE firsts.file END AS file, "
    "md5(CASE WHEN patent % 3 = 0 THEN 'old' ELSE firsts.contents END) AS digest FROM firsts JOIN docs USING (patent, year)",
)
def append_new_docs(spark, sf):
    """A-10: a third of the documents is stored with another text, which stays; of the rest some have no file, and some
    occur twice, in one file, in two, or without one."""
    path = scratch_path(spark, "by-year")
    docs = v.docs(spark, sf)
    D.write_by_year(docs.where("patent % 3 = 0").withColumn("contents", F.lit("old")), path)
    once = docs.withColumn("file", F.expr("CASE WHEN patent % 5 = 1 THEN NULL ELSE file END"))
    again = docs.where("patent % 7 < 2").withColumn("file", F.expr("CASE WHEN patent % 4 = 0 THEN NULL ELSE file END"))
    batch = once.unionByName(again.withColumn("contents", F.concat(F.lit("!"), "contents")))
    D.append_new_docs(batch, path)
    return doc_rows(D.read_by_year(spark, path))


PREPARED = (
    v.DOCS.replace("docs AS", "originals AS"),
    f"started AS (SELECT patent, {unprintable('contents')} AS contents FROM originals WHERE contents <> '')",
    f"cleaned AS (SELECT patent, {clean_sql('contents')} AS contents FROM started)",
    f"prepared AS (SELECT patent, year, file, {remains_sql('c.contents')} AS contents FROM cleaned c JOIN originals USING (patent))",
)


@query(
    "write_cleaned",
    v.sql_with(*PREPARED) + "SELECT file || '_cleaned' AS output, patent, year, md5(contents) AS digest FROM prepared",
)
def write_cleaned(spark, sf):
    """A-12."""
    path = scratch_path(spark, "cleaned")
    D.write_cleaned(Preprocessor(keep_start_section=True).clean(v.docs(spark, sf)), path)
    back = spark.read.schema(schemas.DOCUMENTS + ", output STRING").json(path)
    return back.select("output", "patent", "year", F.md5("contents").alias("digest"))


CSV_SQL = WIDE_SQL.replace("SELECT model,", "SELECT 'vec' AS classifier,").replace("GROUP BY model,", "GROUP BY")


@query(
    "write_scores_csv",
    score_sql([1.0, 2.0, 3.0], f"SELECT t.model, w.* FROM ({CSV_SQL}) w CROSS JOIN (VALUES ('prep1-run-vec'), ('prep2-run-vec')) t(model)"),
)
def write_scores_csv(spark, sf):
    """A-13, T-5: the scores of two preprocessors, whose models are of one kind."""
    path = scratch_path(spark, "scores")
    names = F.explode(F.array(F.lit("prep1-run-vec"), F.lit("prep2-run-vec")))
    wide = scores_wide(dense_scores(spark, sf, [1, 2, 3]).withColumn("model", names))
    D.write_scores_csv(wide, path)
    numbers = [c for c in wide.columns if "-" in c]
    kinds = {"patent_ids": "LONG", "model": "STRING"}
    schema = ", ".join([f"`{c}` {kinds.get(c, 'DOUBLE')}" for c in wide.columns] + ["classifier STRING"])
    back = spark.read.schema(schema).csv(path, header=True)
    return back.select("model", "classifier", "patent_ids", *[F.round(f"`{c}`", 9).alias(c) for c in numbers])


# --- tables and word lists -----------------------------------------------------------------------


def as_tsv(rows, name):
    path = scratch_path(rows.sparkSession, name)
    rows.write.csv(path, sep="\t", header=True)
    return path


@query("read_codes", v.sql_with(v.CODES) + "SELECT * FROM codes")
def read_codes(spark, sf):
    """A-5."""
    return TB.read_codes(spark, as_tsv(v.codes(spark, sf), "codes"))


@query(
    "read_years",
    "SELECT doc_id AS pat, CAST(CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1900 + doc_id % 25 END AS INTEGER) AS year FROM documents",
)
def read_years(spark, sf):
    """A-6."""
    rows = v.docs_with_gaps(spark, sf).select(F.col("patent").alias("pat"), "year")
    return TB.read_years(spark, as_tsv(rows, "years"))


def as_text(rows, name):
    path = f"{scratch_path(rows.sparkSession, name)}.txt"
    rows.write.text(path)
    return path


@query("read_lexicon", v.sql_with(v.LEXICON) + "SELECT word FROM lexicon")
def read_lexicon(spark, sf):
    """A-7: words written with spaces around them, some of them twice."""
    words = v.lexicon(spark, sf)
    lines = words.unionByName(words).select(F.concat(F.lit(" "), "word", F.lit("\t")).alias("value"))
    return TB.read_lexicon(spark, as_text(lines, "lexicon"))


@query(
    "read_wordlists",
    v.sql_with(v.LEXICON, "words AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark)")
    + "SELECT 'stop' AS kind, w AS word, NULL AS standard FROM words WHERE w <> '' UNION "
    "SELECT 'stop', unnest(['.sub.', '.sup.', 'thee']), NULL UNION "
    "SELECT 'symbol', unnest([word, '#' || word]), NULL FROM lexicon UNION "
    "SELECT 'greek', unnest([word || '1', '&' || word || ';']), word FROM lexicon",
)
def read_wordlists(spark, sf):
    """A-8: stop words, symbols and Greek variants."""
    lines = v.table(spark, sf, "benchmark").select(F.col("text").alias("value"))
    stop = TB.read_stop_words(spark, as_text(lines, "stopwords"), ["thee"])
    words = v.lexicon(spark, sf)
    symbols = TB.read_symbols(spark, as_text(words.select(F.concat("word", F.lit(",#"), "word").alias("value")), "symbols"))
    fields = words.select(
        F.lit("?").alias("letter"), F.concat("word", F.lit("1")).alias("Version 1"),
        F.concat(F.lit("&"), "word", F.lit(";")).alias("Version 2"), F.lit("-").alias("Version 3"),
        F.col("word").alias("standard"),
    )
    path = scratch_path(spark, "greek")
    fields.write.csv(path, header=True)
    greek = TB.read_greek(spark, path)
    none = F.lit(None).cast("string").alias("standard")
    return (
        stop.select(F.lit("stop").alias("kind"), "word", none)
        .unionByName(symbols.select(F.lit("symbol").alias("kind"), F.col("symbol").alias("word"), none))
        .unionByName(greek.select(F.lit("greek").alias("kind"), F.col("variant").alias("word"), "standard"))
    )


# --- result store --------------------------------------------------------------------------------

VM = v.sql_members("vectors")
STORED = (v.VECTORS, v.sql_windows(v.SLIDING), VM)


def placed_vectors(spark, sf, model, factor=1.0):
    members = v.members(v.vector_years(spark, sf), v.SLIDING)
    scaled = F.transform("embedding", lambda x: x * factor)
    rows = v.vectors(spark, sf).select("patent", scaled.alias("embedding"))
    return members.join(rows, "patent").select(F.lit(model).alias("model"), "window", "patent", "year", "embedding")


def first_value(rows):
    return rows.select("model", "window", "patent", F.round(F.get("embedding", 0), 6).alias("x"))


FACTOR = "CASE WHEN \"window\" < '1905' THEN 1.0 ELSE 2.0 END"


@query(
    "result_store",
    v.sql_with(*STORED)
    + f"SELECT 'a' AS model, m.\"window\", m.patent, round(embedding[1] * {FACTOR}, 6) AS x FROM members m JOIN vectors USING (patent) UNION ALL "
    'SELECT \'b\', m."window", m.patent, round(embedding[1] * 3.0, 6) FROM members m JOIN vectors USING (patent)',
)
def result_store(spark, sf):
    """A-14: put if absent (early windows keep their first vectors) and overwrite."""
    store = ST.ResultStore(spark, scratch_path(spark, "store"))
    store.put("embeddings", placed_vectors(spark, sf, "a").where("window < '1905'"))
    store.put("embeddings", placed_vectors(spark, sf, "a", 2.0))
    store.put("embeddings", placed_vectors(spark, sf, "b"))
    store.put("embeddings", placed_vectors(spark, sf, "b", 3.0), overwrite=True)
    return first_value(store.read("embeddings"))


@query(
    "catalog",
    v.sql_with(*STORED)
    + "SELECT DISTINCT \"window\", 'a' AS model FROM members UNION SELECT DISTINCT \"window\", 'b' FROM members WHERE year = 1905",
)
def catalog(spark, sf):
    """A-16: which windows have vectors of which model."""
    rows = placed_vectors(spark, sf, "a")
    some = rows.join(rows.where("year = 1905").select("window").distinct(), "window", "left_semi")
    both = rows.unionByName(some.withColumn("model", F.lit("b")).select(*rows.columns))
    return ST.catalog(both)


@query(
    "merge_results",
    v.sql_with(*STORED)
    + f"SELECT 'a' AS model, m.\"window\", m.patent, round(embedding[1] * {FACTOR}, 6) AS x FROM members m JOIN vectors USING (patent)",
)
def merge_results(spark, sf):
    """A-17: vectors of another store are added where this one has none."""
    here = ST.ResultStore(spark, scratch_path(spark, "store"))
    other = ST.ResultStore(spark, scratch_path(spark, "other"))
    here.put("embeddings", placed_vectors(spark, sf, "a").where("window < '1905'"))
    other.put("embeddings", placed_vectors(spark, sf, "a", 2.0))
    here.merge(other.path)
    return first_value(here.read("embeddings"))


@query(
    "remove_model",
    v.sql_with(*STORED)
    + "SELECT 'b' AS model, m.\"window\", m.patent, round(embedding[1], 6) AS x FROM members m JOIN vectors USING (patent)",
)
def remove_model(spark, sf):
    """A-18."""
    store = ST.ResultStore(spark, scratch_path(spark, "store"))
    store.put("embeddings", placed_vectors(spark, sf, "a").unionByName(placed_vectors(spark, sf, "b")))
    store.remove_model("a")
    return first_value(store.read("embeddings"))


@query(
    "pending_runs",
    v.sql_with(v.DOCS, v.sql_windows(v.SLIDING), v.sql_members("docs"))
    + 'SELECT DISTINCT m."window", n AS model FROM members m, (VALUES (\'prep-tfidf\'), (\'prep-counts\')) t(n) '
    "WHERE NOT (n = 'prep-counts' AND m.\"window\" IN (SELECT \"window\" FROM members WHERE year = 1903))",
)
def pending_runs(spark, sf):
    """C-6: windows of one model that hold documents of 1903 are done."""
    members = v.members(v.doc_years(spark, sf), v.SLIDING)
    done = members.where("year = 1903").select("window", F.lit("prep-counts").alias("model"))
    present = v.doc_years(spark, sf).select("year").distinct()
    return ST.pending_runs(v.SLIDING.frame(spark), ["prep-tfidf", "prep-counts"], done, present)


@query("stale_years", "SELECT DISTINCT CAST(1900 + doc_id % 25 AS INTEGER) AS year FROM documents EXCEPT SELECT CAST(1900 + vec_id % 7 AS INTEGER) FROM embeddings")
def stale_years(spark, sf):
    """U-2, G-13: years of the documents that the vectors do not have."""
    seen = v.table(spark, sf, "embeddings").select((1900 + F.col("vec_id") % 7).cast("int").alias("year"))
    return v.doc_years(spark, sf).select("year").distinct().subtract(seen.distinct())


@query(
    "run_models",
    countvec_sql("1.0 / total")
    .replace(v.DOCS, ", ".join((*PREPARED, "docs AS (SELECT patent, year, contents FROM prepared)")))
    .replace("'counts' AS model", "'prep-counts' AS model"),
)
def run_models(spark, sf):
    """E-6 end to end: clean, fit and apply per window, store; every weight of every document and window."""
    from tidemark.plans.runs import run_models as run

    store = ST.ResultStore(spark, scratch_path(spark, "store"))
    prep = {"prep": Preprocessor(keep_start_section=True)}
    run(prep, {"counts": E.WeightedCounts("prop")}, v.EPOCHS, v.docs(spark, sf), v.codes(spark, sf), store)
    rows = store.read("sparse_embeddings").select("model", "window", "patent", "year", "term", "w")
    return v.rounded(rows, "w")
