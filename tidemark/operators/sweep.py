"""Tuning: parameter spaces as tables, trials as group keys of one job."""

from __future__ import annotations

import itertools
import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.operators.clean import Preprocessor
from tidemark.operators.codes import year_pairs
from tidemark.operators.embed import Corpus, Tfidf, WeightedCounts, counts_rows, create_model, tfidf_rows
from tidemark.operators.grading import (
    mean_grade,
    model_grades,
    pair_similarity,
    pair_similarity_sparse,
)
from tidemark.operators.windows import window_years
from tidemark.session import cut_lineage

CALENDAR = 10_000  # years between the calendars of two preprocessor settings


def text_params(params: dict) -> dict[str, str]:
    return {k: str(v) for k, v in params.items()}


def parse_params(params: dict[str, str], search: dict) -> dict:
    """Stored text back to typed values of the parameter space."""
    out = {}
    for key, text in params.items():
        space = search[key]
        if isinstance(space, list):
            out[key] = next(v for v in space if str(v) == text)
        else:
            out[key] = int(text) if space[0] == "int" else float(text)
    return out


def grid(search: dict) -> list[dict]:
    """All combinations of the choices of a space without ranges."""
    names = list(search)
    return [dict(zip(names, values)) for values in itertools.product(*search.values())]


def param_space(spark: SparkSession, label: str, search: dict) -> DataFrame:
    """J-3: one row per combination of the choices (ranges are left to ``random_trials``)."""
    choices = {k: v for k, v in search.items() if isinstance(v, list)}
    rows = spark.range(1).select(F.lit(label).alias("label"))
    for name, values in choices.items():
        rows = rows.select("*", F.explode(F.array(*[F.lit(str(v)) for v in values])).alias(name))
    return rows


def random_trials(search: dict, n: int, seed: int = 0) -> list[dict]:
    """J-4: ``n`` different seeded draws from a space; a longer draw starts with the shorter one.

    A space of fewer than ``n`` settings gives those that a hundred draws for each wanted one have found.
    """
    rng = random.Random(seed)
    out = []
    for _ in range(100 * n):
        if len(out) == n:
            break
        trial = {}
        for name, space in search.items():
            if isinstance(space, list):
                trial[name] = rng.choice(space)
            elif space[0] == "int":
                trial[name] = rng.randint(space[1], space[2])
            else:
                trial[name] = rng.uniform(space[1], space[2])
        if trial not in out:
            out.append(trial)
    return out


def trial_frame(spark: SparkSession, label: str, trials: list[dict]) -> DataFrame:
    rows = [(label, text_params(t)) for t in trials]
    return spark.createDataFrame(rows, "label STRING, params MAP<STRING,STRING>")


def params_key(params=None):
    """Maps are not join keys; their sorted entries are."""
    column = F.col("params") if params is None else params
    entries = F.sort_array(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def pending_trials(trials: DataFrame, finished: DataFrame) -> DataFrame:
    """J-4, J-5: trials that are not in the finished table."""
    left = trials.withColumn("_key", params_key())
    done = finished.select("label", params_key().alias("_key")).distinct()
    return left.join(done, ["label", "_key"], "left_anti").drop("_key")


def tuning_data(
    docs: DataFrame, codes: DataFrame, windows: DataFrame, prep=None, max_per_year: int | None = None,
    k: int = 10, seed: int = 12345, cells: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """J-1: cleaned documents, and code-similarity pairs (never across years) of every window, with their ``cells`` if wanted."""
    years = window_years(windows)
    used = docs.join(years.select("year").distinct(), "year", "left_semi")
    cleaned = (prep or Preprocessor()).clean(used, max_per_year=max_per_year)
    kept = (prep or Preprocessor()).accepted(used, max_per_year).select("patent", "year")
    pairs = year_pairs(kept, codes, k, seed, cells).join(years, "year")
    return cleaned, pairs.select("window", "i", "j", *[c for c in ("cell",) if cells], "correlation")


def objective(
    label: str, kind: str, trials: list[dict], cleaned: DataFrame, pairs: DataFrame, windows: DataFrame,
    **tables,
) -> DataFrame:
    """J-2: ``(label, params, loss)`` for a list of settings of one model class.

    All TF-IDF settings run as one job, and so do those of weighted counts; other classes are one job per setting, whose
    results are joined into one table. A setting whose every window is without a grade has a NULL loss.
    """
    spark = cleaned.sparkSession
    corpus = Corpus.of(cleaned, windows)
    names = {f"{label}-{n:04d}": t for n, t in enumerate(trials)}
    if kind == Tfidf.kind:
        vectors = tfidf_rows(corpus, {n: Tfidf(**t) for n, t in names.items()}, tables.get("stems"))
        similar = pair_similarity_sparse(pairs, vectors)
    elif kind == WeightedCounts.kind:
        similar = pair_similarity_sparse(pairs, counts_rows(corpus, {n: WeightedCounts(**t) for n, t in names.items()}))
    else:
        similar = None
        if len(trials) > 1:  # cleaned once, read by every setting
            cleaned, pairs = cut_lineage(cleaned), cut_lineage(pairs)
            corpus = Corpus.of(cleaned, windows)
        for n, t in names.items():
            model = create_model(kind, {**t, **tables})
            one = pair_similarity_sparse(pairs, model.rows(corpus, n)) if model.sparse else pair_similarity(pairs, model.transform(corpus, n))
            similar = one if similar is None else similar.unionByName(one)
    losses = mean_grade(model_grades(similar)).select(F.col("model").alias("_name"), "loss")
    rows = [(label, n, text_params(t)) for n, t in names.items()]
    params = spark.createDataFrame(rows, "label STRING, _name STRING, params MAP<STRING,STRING>")
    return params.join(losses, "_name", "left").select("label", "params", "loss")


def sweep_models(
    label: str, kind: str, search: dict, max_evals: int, finished: DataFrame | None,
    cleaned: DataFrame, pairs: DataFrame, windows: DataFrame, seed: int = 0, **tables,
) -> DataFrame:
    """J-4: up to ``max_evals`` trials per label; finished trials are kept and not run again."""
    spark = cleaned.sparkSession
    if finished is None:
        finished = spark.createDataFrame([], schemas.TRIALS)
    done = finished.where(F.col("label") == label)
    room = max_evals - done.count()
    if room <= 0:
        return done
    drawn = trial_frame(spark, label, random_trials(search, max_evals, seed))
    rows = pending_trials(drawn, done).collect()  # at most max_evals settings
    left = [parse_params(r["params"], search) for r in rows]
    place = {str(text_params(t)): n for n, t in enumerate(random_trials(search, max_evals, seed))}
    todo = sorted(left, key=lambda t: place[str(text_params(t))])[:room]  # in the order of the draws
    if not todo:
        return done
    return done.unionByName(objective(label, kind, todo, cleaned, pairs, windows, **tables))


def sweep_preprocessors(
    label: str, kind: str, docs: DataFrame, codes: DataFrame, windows: DataFrame,
    finished: DataFrame | None = None, prep_class=Preprocessor, settings: dict | None = None, **tables,
) -> DataFrame:
    """J-5: every combination of the preprocessor's switches, except the finished ones.

    All settings run as one job: each gets a calendar of its own (its years are shifted by CALENDAR),
    so that its documents and windows never meet those of another setting. The switches do not decide
    which documents are accepted, so all settings share their pairs.
    """
    spark = docs.sparkSession
    if finished is None:
        finished = spark.createDataFrame([], schemas.TRIALS)
    done = finished.where(F.col("label") == label)
    todo = pending_trials(trial_frame(spark, label, grid(prep_class.search)), done).collect()  # 2^k rows
    if not todo:
        return done
    preps = [prep_class(**parse_params(row["params"], prep_class.search)) for row in todo]
    used = docs.join(window_years(windows).select("year").distinct(), "year", "left_semi")
    pairs = tuning_data(docs, codes, windows, preps[0], cells=True)[1]
    parts = []
    for n, prep in enumerate(preps):
        cleaned = prep.clean(used)
        parts.append(
            cleaned.select(
                (F.col("patent") * len(preps) + n).alias("patent"), (F.col("year") + n * CALENDAR).alias("year"),
                "contents",
            )
        )
    variant = F.explode(F.sequence(F.lit(0), F.lit(len(preps) - 1)))
    name = F.concat_ws("|", "n", "window").alias("window")
    shifted = windows.withColumn("n", variant).select(
        name, *[(F.col(c) + F.col("n") * CALENDAR).cast("int").alias(c) for c in ("start", "end")]
    )
    ids = [(F.col(c) * len(preps) + F.col("n")).alias(c) for c in ("i", "j")]
    pairs = cut_lineage(pairs).withColumn("n", variant).select(name, *ids, "cell", "correlation")
    model = create_model(kind, {**(settings or {}), **tables})
    corpus = Corpus.of(reduce(DataFrame.unionByName, parts), shifted)
    if model.sparse:
        similar = pair_similarity_sparse(pairs, model.rows(corpus, label))
    else:
        similar = pair_similarity(pairs, model.transform(corpus, label))
    grades = model_grades(similar).withColumn("n", F.split("window", r"\|")[0].cast("int"))
    losses = grades.groupBy("n").agg((-F.avg("spearman")).alias("loss"))
    params = [(label, n, row["params"]) for n, row in enumerate(todo)]
    named = spark.createDataFrame(params, "label STRING, n INT, params MAP<STRING,STRING>")
    return done.unionByName(named.join(losses, "n", "left").select("label", "params", "loss"))


def ranked_trials(trials: DataFrame, label: str | None = None, n: int | None = None) -> DataFrame:
    """T-4: trials by rising loss, those without one last."""
    if label is not None:
        trials = trials.where(F.col("label") == label)
    ranked = trials.orderBy(F.asc_nulls_last("loss"))
    return ranked if n is None else ranked.limit(n)


def best_trial(trials: DataFrame) -> DataFrame:
    """T-4: the setting with the smallest loss of every label."""
    return trials.groupBy("label").agg(
        F.min_by("params", "loss").alias("params"), F.min("loss").alias("loss")
    )


def best_preprocessor(trials: DataFrame, label: str, prep_class=Preprocessor):
    """The preprocessor of the best trial."""
    row = ranked_trials(trials, label, 1).first()
    if row is None:
        raise KeyError(f"no trials for {label!r}")
    return prep_class(**parse_params(row["params"], prep_class.search))


def best_model(trials: DataFrame, label: str, kind: str, search: dict):
    """The embedder of the best trial."""
    row = ranked_trials(trials, label, 1).first()
    if row is None:
        raise KeyError(f"no trials for {label!r}")
    return create_model(kind, parse_params(row["params"], search))
