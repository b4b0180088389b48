"""Licence scans: TF-IDF cosine of a file's lines to licence statements, then inheritance from the nearest directory.

1. A file's text falls into lines, and lines into sentences. Each is a vector over the words of the statement templates; its other
   words weigh as if no file had them, and add to its length only. A word's idf comes from all files.
2. A sentence is compared only if it has a word of some template without which the rest of that template cannot reach
   the threshold (the prefix of its words by weight), so sentences that are left out cannot match.
3. A file's licence is its best match; of equal scores the first by name. Licence files (by name) speak for their
   directory. A file without a licence takes that of the nearest directory above it that has one, by a join of its
   directory's ancestors with the licensed directories. Directories are resolved once each, however many files they hold.

DataFrame functions only. Files with a null path have no directory; files with null or empty texts have no licence
of their own. Several licence files in one directory: the best score, then the first name. Rows are kept one for one, so
repeated paths stay repeated (each with its own text); they need an id that is theirs alone only for equal paths and ids.
Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut_lineage

# Usual one-sentence statements of public licences, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "licensed under the apache license version 2.0",
    "BSD-2-Clause": "use of this source code is governed by a bsd 2 clause license",
    "BSD-3-Clause": "use of this source code is governed by a bsd style license",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "CC-BY-NC-4.0": "licensed under cc by nc 4.0",
    "CC-BY-SA-4.0": "licensed under cc by sa 4.0",
    "CC0-1.0": "released under cc0 1.0 universal public domain dedication",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "ISC": "released under the isc license",
    "LGPL-3.0": "this work is licensed under the gnu lesser general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "subject to the terms of the mozilla public license version 2.0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
}
LICENCE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"


def words(text: Column) -> Column:
    """Lower-case words; a version number is one word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:\.[0-9]+)*)"), F.lit(1))


def term_table(files: DataFrame, templates: dict[str, str]) -> tuple[list[tuple[str, str, float]], float]:
    """(licence, term, idf) of every template word, and the idf of a word that no file has."""
    pairs = sorted({(name, term) for name, text in templates.items() for term in text.split()})
    vocabulary = sorted({term for _, term in pairs})
    seen = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = files.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    found = files.select(F.explode(seen).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in found.collect()}  # the templates' words
    idf = F.log((F.lit(counts) + 1.0) / (F.col("df") + 1.0)) + 1.0
    spark = files.sparkSession
    rows = spark.createDataFrame([(t, df.get(t, 0)) for t in ["", *vocabulary]], "term string, df long")
    values = {r["term"]: r["idf"] for r in rows.select("term", idf.alias("idf")).collect()}
    return [(name, term, values[term]) for name, term in pairs], values[""]


def needed_words(terms: list[tuple[str, str, float]], threshold: float) -> list[str]:
    """For every template, its heaviest words until the rest alone cannot reach the threshold."""
    needed = set()
    for name in sorted({name for name, _, _ in terms}):
        own = sorted(((w, t) for n, t, w in terms if n == name), reverse=True)
        rest = whole = sum(w * w for w, _ in own)
        for weight, term in own:
            if (rest / whole) ** 0.5 < threshold - 1e-9:
                break
            needed.add(term)
            rest -= weight * weight
    return sorted(needed)


def own_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """(id, licence, score) of the files that state one: cosine of the best sentence, rounded to six places."""
    files = files.select("id", "text")
    terms, unseen = term_table(files, templates)
    spark = files.sparkSession
    anchors = "|".join(t.replace(".", r"\.") for t in needed_words(terms, threshold))
    parts = F.split(F.regexp_replace("text", r"([.!?;])\s+", "$1\n"), "\n")
    sentences = files.select("id", F.posexplode(parts).alias("at", "line")).where(
        F.lower("line").rlike(rf"(^|[^\p{{L}}\p{{N}}])({anchors})([^\p{{L}}\p{{N}}]|$)")
    )
    bags = sentences.select("id", "at", F.explode(words(F.col("line"))).alias("term")).groupBy("id", "at", "term").agg(
        F.count(F.lit(1)).cast("double").alias("tf")
    )
    weights = spark.createDataFrame(sorted({(t, w) for _, t, w in terms}), "term string, idf double")
    known = bags.join(F.broadcast(weights), "term", "left")  # the templates' words
    weight = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    lengths = known.groupBy("id", "at").agg(F.sum(weight * weight).alias("squares"))
    squares = {}
    for name, _, w in terms:
        squares[name] = squares.get(name, 0.0) + w * w
    table = spark.createDataFrame([(n, t, w / squares[n] ** 0.5) for n, t, w in terms], "licence string, term string, part double")
    dots = known.where("idf IS NOT NULL").join(F.broadcast(table), "term").groupBy("id", "at", "licence").agg(
        F.sum(weight * F.col("part")).alias("dot")
    )
    scored = dots.join(lengths, ["id", "at"]).select("id", "licence", F.round(F.col("dot") / F.sqrt("squares"), 6).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("id", "licence").agg(F.max("score").alias("score"))
    top = best.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("top"))
    return top.select("id", "top.licence", (-F.col("top.minus")).alias("score"))


def ancestors(directory: Column) -> Column:
    """A directory and all above it; the root is the empty string."""
    steps = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, F.lit(1), k))
    )


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """(id, path, licence, score, origin) for every row of ``files`` (id, path, text).

    ``origin`` is 'own', 'inherited' or 'none'; an inherited licence has the score of the licence file it comes from.
    """
    files = files.select("id", "path", "text")
    own = cut_lineage(own_licences(files, templates, threshold))
    directory, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    placed = files.select("id", "path", directory.alias("directory"), name.alias("name"))
    speakers = placed.where(F.col("path").isNotNull() & F.col("name").rlike(LICENCE_NAMES)).join(own, "id")
    licensed = speakers.groupBy(F.col("directory").alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "name", "licence")).alias("said")
    )
    directories = placed.where("path IS NOT NULL").select("directory").distinct()
    chains = directories.select("directory", F.explode(F.array_distinct(ancestors(F.col("directory")))).alias("above"))
    nearest = chains.join(licensed, "above").groupBy("directory").agg(F.max_by("said", F.length("above")).alias("said"))
    inherited = nearest.select("directory", F.col("said.licence").alias("from_above"), (-F.col("said.minus")).alias("score_above"))
    joined = placed.join(own, "id", "left").join(inherited, "directory", "left")
    return joined.select(
        "id", "path", F.coalesce("licence", "from_above").alias("licence"), F.coalesce("score", "score_above").alias("score"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("from_above").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )
