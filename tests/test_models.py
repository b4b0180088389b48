"""Embedders, tuning and whole runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import embed as E, sweep as SW
from tidemark.operators.clean import Preprocessor
from tidemark.operators.windows import WindowSpec
from tidemark.plans import runs
from tidemark.plans import views as v
from tidemark.sources.store import ResultStore

TEXTS = [
    "the lever moves the wheel", "a wheel and a lever and a wheel", "the engine burns coal gas", "coal heats the engine",
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(i, 1900 + i % 2, t) for i, t in enumerate(TEXTS)], "patent long, year int, contents string")
    return E.Corpus.of(docs, WindowSpec(1900, 1902, 2, 2).frame(spark))


def by_doc(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["patent"], {})[r["term"]] = r["w"]
    return out


def test_tfidf(corpus):
    got = by_doc(E.Tfidf(stop_words=None, min_df=2, norm="l2").transform(corpus, "m"))
    idf = lambda df: math.log(5 / (1 + df)) + 1
    want = {"the": 2 * idf(3), "lever": idf(2), "wheel": idf(2)}
    length = math.sqrt(sum(x * x for x in want.values()))
    assert got[0] == {t: pytest.approx(x / length) for t, x in want.items()}
    none = by_doc(E.Tfidf(stop_words="english", min_df=99, norm=None).transform(corpus, "m"))
    assert all(not terms for terms in none.values())
    with pytest.raises(ValueError):
        E.Tfidf(stem=True).transform(corpus, "m")


def test_many_settings_in_one_job(corpus):
    models = {"a": E.Tfidf(stop_words=None, min_df=1), "b": E.Tfidf(stop_words=None, min_df=1, ngram_max=2, norm=None)}
    both = E.tfidf(corpus, models)
    for name, model in models.items():
        alone = by_doc(model.transform(corpus, name))
        assert by_doc(both.where(F.col("model") == name)) == {
            p: {t: pytest.approx(w) for t, w in terms.items()} for p, terms in alone.items()
        }


def test_stems(spark, corpus):
    stems = spark.createDataFrame([("moves", "move"), ("burns", "burn")], "token string, stem string")
    got = by_doc(E.Tfidf(stop_words=None, stem=True, min_df=1).transform(corpus, "m", stems))
    assert "move" in got[0] and "moves" not in got[0] and "burn" in got[2]


@pytest.mark.parametrize("method", ["prop", "sigmoid"])
def test_counts(corpus, method):
    got = by_doc(E.WeightedCounts(method).transform(corpus, "m"))
    assert all(sum(w * w for w in terms.values()) == pytest.approx(1) for terms in got.values())
    if method == "prop":
        assert got[0]["moves"] / got[0]["the"] == pytest.approx((1 / 1) / (2 / 4))


def test_token_vectors(spark, corpus):
    rng = np.random.default_rng(0)
    table = {t: rng.normal(size=4) for t in sorted({w for t in TEXTS for w in t.split()})}
    rows = spark.createDataFrame([(t, x.tolist()) for t, x in table.items()], "token string, vector array<double>")
    raw = E.TokenVectorMean(vector_size=4, token_vectors=rows, remove_common=False).transform(corpus, "m")
    want = {}
    for i, text in enumerate(TEXTS):
        words = text.split()
        f = np.array([1 / (1 + 1000 * sum(w in t.split() for t in TEXTS) / 4) for w in words])
        want[i] = (f[:, None] * np.array([table[w] for w in words])).sum(axis=0) / f.sum()
    for r in raw.collect():
        assert r["embedding"] == pytest.approx(want[r["patent"]])
    x = np.array([want[i] for i in range(4)])
    direction = np.linalg.svd(x)[2][0]
    rest = x - np.outer(x @ direction, direction)
    for r in E.TokenVectorMean(vector_size=4, token_vectors=rows).transform(corpus, "m").collect():
        assert r["embedding"] == pytest.approx(rest[r["patent"]], abs=1e-9)
    with pytest.raises(ValueError):
        E.TokenVectorMean().transform(corpus, "m")
    keyed = rows.selectExpr("token", "vector", "1000 AS vocab_size").unionByName(
        rows.selectExpr("token", "slice(vector, 1, 2) AS vector", "3000 AS vocab_size")
    )
    sizes = {}
    for size, vocabulary in ((4, 1000), (2, 3000), (2, 1000)):
        model = E.TokenVectorMean(size, vocabulary, False, token_vectors=keyed)
        sizes[size, vocabulary] = {len(r["embedding"]) for r in model.transform(corpus, "m").collect()}
    assert sizes == {(4, 1000): {4}, (2, 3000): {2}, (2, 1000): set()}


def test_trained_and_pretrained(spark, corpus):
    trained = E.TrainedVectors(vector_size=5, min_count=1, epoch=1).transform(corpus, "m").collect()
    assert len(trained) == 4 and all(len(r["embedding"]) == 5 for r in trained)
    encoder = E.PretrainedEncoder(loader=E.hashing_encoder(16))
    assert all(len(r["embedding"]) == 16 for r in encoder.transform(corpus, "m").collect())
    other = E.PretrainedEncoder("anferico/bert-for-patents", loader=E.hashing_encoder(16)).encode(corpus.docs)
    assert {tuple(r["embedding"]) for r in other.collect()} != {tuple(r["embedding"]) for r in encoder.encode(corpus.docs).collect()}
    with pytest.raises(ValueError):
        E.PretrainedEncoder().encode(corpus.docs)
    with pytest.raises(Exception, match="there is no encoder"):
        E.PretrainedEncoder("no such model", loader=E.hashing_encoder()).encode(corpus.docs).collect()
    stored = spark.createDataFrame([(0, 1900, [9.0])], "patent long, year int, embedding array<double>")
    got = {r["patent"]: r["embedding"] for r in encoder.encode_new(corpus.docs, stored).collect()}
    assert got[0] == [9.0] and len(got) == 4


def test_trained_vectors_find_words_once(spark):
    """the words of a document are written once, and read by all windows that hold it."""
    rows = [(i, 1900 + i % 6, "lever arm gear wheel " * 3) for i in range(12)] + [(12, 1990, "no window")]
    docs = spark.createDataFrame(rows, "patent long, year int, contents string")
    corpus = E.Corpus.of(docs, WindowSpec(1900, 1906, 3, 1).frame(spark))
    got = E.TrainedVectors(vector_size=3, min_count=1, epoch=1, partitions=2).transform(corpus, "m")
    want = sorted((r["window"], r["patent"], r["year"]) for r in corpus.members.collect())
    assert want and sorted((r["window"], r["patent"], r["year"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Join" not in plan


def test_param_space(spark):
    space = SW.param_space(spark, "tfidf", E.Tfidf.search)
    assert space.count() == 3 * 2 * 2 * 3 * 2 and space.distinct().count() == space.count()
    assert len(SW.grid(Preprocessor.search)) == 8
    draws = SW.random_trials(E.Tfidf.search, 5, seed=1)
    assert draws == SW.random_trials(E.Tfidf.search, 9, seed=1)[:5]
    for d in draws:
        assert SW.parse_params(SW.text_params(d), E.Tfidf.search) == d and 1 <= d["min_df"] <= 9


def test_trials(spark):
    rows = [("a", {"x": "1"}, 0.3), ("a", {"x": "2"}, 0.1), ("b", {"x": "1"}, 0.2)]
    trials = spark.createDataFrame(rows, "label string, params map<string,string>, loss double")
    assert {r["label"]: r["params"]["x"] for r in SW.best_trial(trials).collect()} == {"a": "2", "b": "1"}
    assert SW.best_model(
        spark.createDataFrame([("c", {"method": "prop"}, 0.1)], trials.schema), "c", "WeightedCounts", E.WeightedCounts.search
    ) == E.WeightedCounts("prop")
    with pytest.raises(KeyError):
        SW.best_model(trials, "none", "WeightedCounts", E.WeightedCounts.search)
    todo = SW.pending_trials(SW.trial_frame(spark, "a", [{"x": 1}, {"x": 3}]), trials).collect()
    assert [r["params"] for r in todo] == [{"x": "3"}]


def test_sweep_resumes(spark, sf):
    windows = v.EPOCHS.frame(spark)
    cleaned, pairs = SW.tuning_data(v.docs(spark, sf), v.codes(spark, sf), windows)
    finished = spark.createDataFrame([("c", {"method": m}, -1.0) for m in ("prop", "sigmoid")], SW.schemas.TRIALS)
    got = SW.sweep_models("c", "WeightedCounts", E.WeightedCounts.search, 2, finished, cleaned, pairs, windows)
    assert got.where("loss = -1").count() == 2 and got.count() == 2


def test_stored_sweep_commits_in_batches(spark, sf, tmp_path):
    windows = v.EPOCHS.frame(spark)
    cleaned, pairs = SW.tuning_data(v.docs(spark, sf), v.codes(spark, sf), windows)
    store = ResultStore(spark, str(tmp_path / "res"))
    sweep = lambda n: runs.sweep_run(store, "c", "WeightedCounts", E.WeightedCounts.search, n, cleaned, pairs, windows, batch=1)
    first = sweep(1).collect()
    both = {r["params"]["method"]: r["loss"] for r in sweep(2).collect()}
    assert len(first) == 1 and set(both) == {"prop", "sigmoid"} and both[first[0]["params"]["method"]] == first[0]["loss"]
    assert SW.best_model(store.read("trials"), "c", "WeightedCounts", E.WeightedCounts.search).method == min(both, key=both.get)
    preps = spark.createDataFrame([("p", {"keep_caps": "True"}, 0.2), ("p", {"keep_caps": "False"}, 0.3)], SW.schemas.TRIALS)
    assert SW.best_preprocessor(preps, "p") == Preprocessor(keep_caps=True)


def test_tokenizer_of_term_weights(spark, corpus):
    every = E.Tfidf(stop_words=None, norm=None, min_df=1, tokenizer=lambda c: F.split(F.lower(c), ""))
    terms = {r["term"] for r in every.transform(corpus, "m").collect()}
    assert terms and all(len(t) <= 1 for t in terms) and "tokenizer" not in every.settings()


def test_run_score_grade(spark, sf, tmp_path):
    store = ResultStore(spark, str(tmp_path / "res"))
    spec = WindowSpec(1900, 1912, 11, 1)
    docs, codes = v.docs(spark, sf), v.codes(spark, sf)
    models = {"tfidf": E.Tfidf(stop_words=v.STOP_WORDS), "hash": E.PretrainedEncoder(loader=E.hashing_encoder(8))}
    runs.run_models(None, models, spec, docs, codes, store)
    runs.run_models(None, models, spec, docs, codes, store)  # nothing left to do
    assert store.runs().count() == 4 and store.has_cpc("1900-1910")
    scores = runs.store_scores(store, [1, 2]).collect()
    assert len(scores) == 2 * 2 * 2 * 8 and all(r["novelty"] is not None for r in scores)
    grades = runs.grade_run(store).collect()
    assert len(grades) == 4 and all(-1 <= r["spearman"] <= 1 for r in grades)
    assert runs.grade_run(store, "default-hash").count() == 2
    wide = runs.score_run(store, str(tmp_path / "csv"), [1.0, 2.0])
    assert wide.count() == 2 * 16
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert {r["classifier"] for r in back.select("classifier").distinct().collect()} == {"tfidf", "hash"}
    with pytest.raises(ValueError):
        runs.run_models(None, models, WindowSpec(1900, 1912, 10, 1), docs, codes, store)
    with pytest.raises(ValueError):
        runs.run_pretrained({"p": Preprocessor()}, {"tfidf": models["tfidf"]}, spec, docs, codes, store)


def test_windows_without_a_grade_are_counted(spark):
    from tidemark.operators.grading import mean_grade

    rows = [("a", "w1", 0.5), ("a", "w2", None), ("a", "w3", 0.25), ("b", "w1", None)]
    grades = {r["model"]: r for r in mean_grade(spark.createDataFrame(rows, "model STRING, window STRING, spearman DOUBLE")).collect()}
    assert (grades["a"]["loss"], grades["a"]["ungraded"]) == (-0.375, 1)
    assert (grades["b"]["loss"], grades["b"]["ungraded"]) == (None, 1)


def test_settings_without_a_grade_keep_their_row_and_come_last(spark):
    docs = spark.createDataFrame([(1, 1901, "one two"), (2, 1901, "two three")], "patent LONG, year INT, contents STRING")
    pairs = spark.createDataFrame([("1900-1904", 1, 2, 0.5)], "window STRING, i LONG, j LONG, correlation DOUBLE")
    windows = WindowSpec(1900, 1905, 5, 5).frame(spark)
    trials = SW.objective("c", E.WeightedCounts.kind, [{"method": "prop"}, {"method": "sigmoid"}], docs, pairs, windows)
    assert [r["loss"] for r in trials.collect()] == [None, None]
    done = spark.createDataFrame([("c", {"method": "x"}, -0.5)], SW.schemas.TRIALS)
    ranked = SW.ranked_trials(trials.unionByName(done)).collect()
    assert [r["loss"] for r in ranked] == [-0.5, None, None]


def test_vectors_of_pairs_are_made_once(spark):
    """The arrays of a document are written once; neither side of a pair makes the vectors anew."""
    from tidemark.operators import grading as G

    rows = spark.range(4).selectExpr("'m' AS model", "'w' AS window", "id AS patent", "'t' AS term", "CAST(id AS DOUBLE) AS w")
    pairs = spark.createDataFrame([("w", 1, 2), ("w", 2, 3), ("w", 3, 9)], "window string, i long, j long")
    got = G.pair_similarity_sparse(pairs, rows)
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["i"], r["j"]): r["similarity"] for r in got.collect()} == {(1, 2): 2.0, (2, 3): 6.0, (3, 9): 0.0}


def test_documents_meet_the_weights_of_their_block(spark, corpus, monkeypatch):
    """One row per document, the same in one block and in blocks of a few terms, with overlapping windows and samples too."""
    windows = WindowSpec(1900, 1904, 2, 1).frame(spark)
    docs = corpus.docs.unionByName(corpus.docs.limit(1).withColumn("year", F.lit(1901)))  # an id in two years
    members = spark.createDataFrame([("1900-1901", 0, 1900), ("1900-1901", 1, 1901)], "window string, patent long, year int")
    models = {"a": E.Tfidf(stop_words=None, min_df=1, ngram_max=2), "b": E.Tfidf(stop_words=None, min_df=1, norm="l2")}

    def found():
        of = [E.Corpus.of(docs, windows), E.Corpus.of(corpus.docs, windows, members)]
        rows = [E.tfidf_rows(c, models) for c in of] + [E.WeightedCounts("sigmoid").rows(c, "c") for c in of]
        return [sorted((r["model"], r["window"], r["patent"], r["year"], sorted(r["v"])) for r in x.collect()) for x in rows]

    one = found()
    monkeypatch.setattr(E, "BLOCK", 4)
    monkeypatch.setattr(E, "SMALLEST", 2)
    assert found() == one and all(one)
    lengths = {}
    for model, window, patent, _, v in one[0]:
        key = model, window, patent
        lengths[key] = lengths.get(key, 0) + sum(w * w if model == "b" else w for _, w in v)
    assert list(lengths.values()) == pytest.approx([1.0] * len(lengths))


def test_pairs_meet_in_cells(spark, monkeypatch):
    """a document travels to one cell for almost all of its partners, not once with every pair."""
    from tidemark.operators import codes as C, grading as G

    monkeypatch.setattr(C, "CELL", 200)
    monkeypatch.setattr(G, "CELL", 200)
    docs = spark.range(3000).selectExpr("'w' AS window", "id * 7 AS patent")
    sampled = C.sample_pairs(docs, ["window"], 10, 3, cells=True)
    assert sorted(sampled.drop("cell").collect()) == sorted(C.sample_pairs(docs, ["window"], 10, 3).collect())
    found = sampled.toPandas()
    assert found["cell"].nunique() == 15 and found.groupby("j")["cell"].nunique().max() == 1
    assert found.groupby("i")["cell"].nunique().mean() < 2.2 and found.groupby("cell")["j"].nunique().max() <= 220

    rng = np.random.default_rng(5)
    vectors = {i * 7: {f"t{t}": float(x) for t, x in zip(rng.choice(40, 6, False), rng.normal(size=6))} for i in range(0, 3000, 2)}
    rows = [("m", "w", p, list(ws.items())) for p, ws in vectors.items()]
    rows += [("m", "w", 0, [("t1", 2.0), ("t2", 1.0)]), ("m", "w", None, [("t1", 1.0)]), ("other", "w", 9_999_999, [("t1", 1.0)])]
    for t, x in (("t1", 2.0), ("t2", 1.0)):  # an id of two rows is one document
        vectors[0][t] = vectors[0].get(t, 0.0) + x
    embeddings = spark.createDataFrame(rows, "model string, window string, patent long, v array<struct<term: string, w: double>>")
    pairs = sampled.unionByName(spark.createDataFrame([("w", 0, 0, 1), ("w", None, 7, 1)], "window string, i long, j long, cell long"))
    dot = lambda a, b: sum(x * vectors[b][t] for t, x in vectors.get(a, {}).items() if t in vectors.get(b, {}))
    for case in (pairs, pairs.drop("cell")):
        got = G.pair_similarity_sparse(case, embeddings).toPandas()
        assert list(got.columns) == ["model", "window", "i", "j", "similarity"] and len(got) == 2 * 30_002
        assert (got[got.model == "other"].similarity == 0).all()
        for _, _, i, j, s in got[got.model == "m"].sample(3000, random_state=1).itertuples(index=False):
            assert s == pytest.approx(dot(i, j), abs=1e-12)
        for i in (0, 7):
            assert {(j, round(s, 9)) for j, s in got[(got.model == "m") & (got.i == i)][["j", "similarity"]].itertuples(index=False)} == {
                (j, round(dot(i, j), 9)) for j in got[(got.model == "m") & (got.i == i)]["j"]
            }


def test_packages_give_back_their_rows():
    import pyarrow as pa

    from tidemark.operators.packed import Rows

    kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64()), ("tf", pa.int64())]))
    entries = [[("b", 0.1, 3), ("a", -1e-300, 1 << 40)], [], None, [("é", 2.0, -5), ("", 0.0, 0), ("b", 7.5, 1)]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4]), pa.array([e and [dict(zip(("term", "w", "tf"), x)) for x in e] for e in entries], kind)], names=["patent", "v"])
    rows = Rows.of(batch, "v")
    for some in (rows, Rows.concat([rows.take(np.array([3])), rows]).take(np.array([1, 2, 3, 4]))):
        back = Rows.unpack(some.pack())
        terms = [back.names[c].as_py() for c in back.codes.tolist()]
        assert back.own.column("patent").to_pylist() == [1, None, 3, 4] and back.lens.tolist() == [2, 0, 0, 3]
        assert list(zip(terms, back.fields["w"].tolist(), back.fields["tf"].tolist())) == [x for e in entries for x in e or []]


def test_trained_vectors_do_the_whole_job(spark, sf, monkeypatch):
    """the query trains with the default settings. F8: a window's vectors are written before the next is trained."""
    from tidemark.plans import vector_queries as Q

    with monkeypatch.context() as m:
        m.setattr(E.TrainedVectors, "transform", lambda self, corpus, name: self)
        assert Q.doc2vec(spark, sf).settings() == {"vector_size": 100, "min_count": 2, "epoch": 10}
    docs = spark.createDataFrame([(i, 1900 + i % 2, "lever arm gear wheel " * 3) for i in range(8)], "patent long, year int, contents string")
    corpus = E.Corpus.of(docs, WindowSpec(1900, 1902, 1, 1).frame(spark))
    got = E.TrainedVectors(vector_size=3, min_count=1, epoch=1, partitions=2).transform(corpus, "m")
    assert "UDF" not in got._jdf.queryExecution().optimizedPlan().toString() and got.select("window").distinct().count() > 1


def test_documents_travel_packed_to_their_block(spark, corpus):
    """no term of a document is a row of a shuffle; counts of a block's terms are the same, null ids and two orders too."""
    docs = corpus.docs.unionByName(spark.createDataFrame([(None, 1900, "a wheel wheel"), (9, 1901, "")], corpus.docs.schema))
    both = E.Corpus.of(docs, corpus.windows)
    counts = E.counted_docs(docs.select("patent", "year", F.split("contents", " ").alias("tokens")), 2)
    placed, held = both.term_blocks(counts)
    assert "Generate inline(counted" not in held._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["order"], r["term"]): (r["df"], r["total"]) for r in held.collect()}
    want = {}
    for text in [*TEXTS, "a wheel wheel", ""]:
        words = text.split(" ")
        grams = [(1, w) for w in words] + [(2, " ".join(p)) for p in zip(words, words[1:])]
        for g in set(grams):
            df, total = want.get(g, (0, 0))
            want[g] = (df + 1, total + grams.count(g))
    assert got == want


def test_settings_of_weighted_counts_share_their_counts(spark, corpus, monkeypatch):
    """words are cleaned and counted once for all settings of a sweep, and every setting gets the vectors it gets alone."""
    made = []
    monkeypatch.setattr(E, "counted_docs", lambda *a, f=E.counted_docs: made.append(a) or f(*a))
    methods = ("prop", "sigmoid")
    both = {}
    for r in E.counts_rows(corpus, {m: E.WeightedCounts(m) for m in methods}).collect():
        both.setdefault(r["model"], {})[r["patent"]] = sorted(r["v"])
    assert both == {m: {r["patent"]: sorted(r["v"]) for r in E.WeightedCounts(m).rows(corpus, m).collect()} for m in methods}
    made.clear()
    pairs = spark.createDataFrame([("1900-1901", 0, 1, 0.5), ("1900-1901", 2, 3, 0.9)], "window string, i long, j long, correlation double")
    trials = SW.objective("c", E.WeightedCounts.kind, [{"method": m} for m in methods], corpus.docs, pairs, corpus.windows)
    assert trials.where("loss IS NOT NULL").count() == 2 and len(made) == 1
