"""Whole runs: documents to vectors, vectors to scores, vectors to grades, into a result store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.clean import Preprocessor
from tidemark.operators.codes import window_pairs
from tidemark.operators.embed import Corpus
from tidemark.operators.grading import (
    filter_models,
    grades_cached,
    model_grades,
    pair_similarity,
    pair_similarity_sparse,
)
from tidemark.operators.scores import novelty_impact, novelty_impact_sparse, scores_cached, scores_wide
from tidemark.operators.sweep import sweep_models
from tidemark.operators.windows import WindowSpec, assign_windows, sample_window, window_years
from tidemark.session import cut_lineage
from tidemark.sources.documents import write_scores_csv
from tidemark.sources.store import ResultStore, pending_runs


def run_models(
    preprocessors: dict | None, models: dict, spec: WindowSpec, docs: DataFrame, codes: DataFrame,
    store: ResultStore, seed: int = 0, tables: dict | None = None,
) -> None:
    """E-6: fit and apply every model on every window of the specification; skip what is stored.

    Windows are group keys: each (preprocessor, model) pair is one job over all its open windows.
    """
    spark = docs.sparkSession
    preprocessors = preprocessors or {"default": Preprocessor()}
    if not store.check_spec(spec):
        raise ValueError("the store holds results of another run specification")
    store.put_settings("model", models)
    store.put_settings("preprocessor", preprocessors)

    windows = spec.frame(spark)
    first = next(iter(preprocessors.values()))
    present = docs.select("year").distinct()
    names = [f"{p}-{m}" for p in preprocessors for m in models]
    pending = pending_runs(windows, names, store.runs(), present)

    accepted = first.accepted(docs, spec.max_docs_per_year).select("patent", "year")
    members = assign_windows(accepted, windows.select("window", "start", "end")).select("window", "patent", "year")
    if spec.docs_per_window is not None:
        members = sample_window(members, spec.docs_per_window, seed)
    fresh = members.join(store.window_list(), "window", "left_anti")
    store.put_window(fresh)
    members = store.read("windows")
    uncovered = members.join(store.read("cpc").select("window").distinct(), "window", "left_anti")
    store.put("cpc", window_pairs(uncovered, codes, spec.pairs_per_doc))

    for prep_name, prep in preprocessors.items():
        years = window_years(windows).select("year").distinct()
        cleaned = prep.clean(docs.join(years, "year", "left_semi"), max_per_year=spec.max_docs_per_year)
        cleaned = cleaned.select("patent", "year", "contents")
        if len(models) > 1:
            cleaned = cut_lineage(cleaned)  # cleaned once, read by every model
        for model_name, model in models.items():
            name = f"{prep_name}-{model_name}"
            todo = pending.where(F.col("model") == name).select("window")
            open_windows = windows.join(todo, "window", "left_semi")
            if open_windows.isEmpty():
                continue
            sampled = members.join(todo, "window", "left_semi") if spec.docs_per_window else None
            corpus = Corpus.of(cleaned, open_windows, sampled)
            vectors = model.transform(corpus, name, **(tables or {}).get(model_name, {}))
            store.put("sparse_embeddings" if model.sparse else "embeddings", vectors)


def run_pretrained(
    preprocessors: dict, models: dict, spec: WindowSpec, docs: DataFrame, codes: DataFrame,
    store: ResultStore, seed: int = 0,
) -> None:
    """E-7: models that need no fit; every document is encoded once and shared by its windows."""
    if not all(getattr(m, "pretrained", False) for m in models.values()):
        raise ValueError("run_pretrained takes pretrained models only")
    run_models(preprocessors, models, spec, docs, codes, store, seed)


def store_scores(store: ResultStore, exponents=(1.0, 2.0, 3.0), cache: bool = True) -> DataFrame:
    """G-4, J-6: scores of every stored (window, model) pair, computing only what is missing."""
    runs = store.runs()
    exponents = [float(p) for p in exponents]
    requested = runs.withColumn("exponent", F.explode(F.array(*[F.lit(p) for p in exponents])))
    windows = store.read("windows")

    def compute(missing: DataFrame) -> DataFrame:
        pick = lambda t: store.read(t).join(missing, ["model", "window"], "left_semi")
        parts = []
        dense, sparse = pick("embeddings"), pick("sparse_embeddings")
        if not dense.isEmpty():
            parts.append(novelty_impact(dense, windows, exponents))
        if not sparse.isEmpty():
            parts.append(novelty_impact_sparse(sparse, windows, exponents))
        out = store.read("impact_novelty").limit(0)
        for part in parts:
            out = out.unionByName(part)
        return out

    scores = scores_cached(requested, store.read("impact_novelty"), compute)
    if cache:
        store.put("impact_novelty", scores)
        keys = ["model", "window", "exponent"]
        scores = store.read("impact_novelty").join(requested, keys, "left_semi")
    return scores


def sweep_run(
    store: ResultStore, label: str, kind: str, search: dict, max_evals: int, cleaned: DataFrame, pairs: DataFrame,
    windows: DataFrame, seed: int = 0, batch: int = 10, **tables,
) -> DataFrame:
    """J-4 with a store: trials are committed every ``batch`` evaluations, so a sweep that breaks off goes on from there."""
    for upto in range(min(batch, max_evals), max_evals + batch, batch):
        finished = store.read("trials").where(F.col("label") == label)
        store.put_trials(
            sweep_models(label, kind, search, min(upto, max_evals), finished, cleaned, pairs, windows, seed, **tables)
        )
    return store.read("trials").where(F.col("label") == label)


def score_run(store: ResultStore, out_dir: str, exponents=(1.0, 2.0, 3.0)) -> DataFrame:
    """J-6, J-7, A-13: score everything and write one CSV folder per model."""
    wide = scores_wide(store_scores(store, exponents, cache=False), list(exponents))
    write_scores_csv(wide, out_dir)
    return wide


def grade_run(store: ResultStore, models=None) -> DataFrame:
    """G-8: grades of the stored models per window, cached in the store."""
    stored = filter_models(store.read("model_scores"), models)
    pairs = store.read("cpc")
    have = ["model", "window"]
    dense = filter_models(store.read("embeddings"), models).join(stored, have, "left_anti")
    sparse = filter_models(store.read("sparse_embeddings"), models).join(stored, have, "left_anti")
    similar = pair_similarity(pairs, dense).unionByName(pair_similarity_sparse(pairs, sparse))
    grades = model_grades(similar)
    store.put("model_scores", grades)
    return grades_cached(filter_models(store.read("model_scores"), models), similar.limit(0))


def grade_series(grades: DataFrame) -> DataFrame:
    """J-8: (year, spearman) by model, ready to plot."""
    return grades.select("model", "year", "spearman").orderBy("model", "year")
