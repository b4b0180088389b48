"""Toxicity and language: decoding, accuracy on rows held out, edge cases."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import language, text_queries, toxicity
from tidemark.session import cut_lineage

DOCS = "doc_id long, text string, lang string, toxic string, score string"
DISGUISED = {
    "1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiiiiot": "idiot", "$tup1d": "stupid", "m0r0n": "moron",
    "p4th3t1c": "pathetic", "tr@$h": "trash", "l0$er!!": "loser", "cl0wn###": "clown", "scuuuum": "scum", "s-c-u-m": "scum",
}


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(text_queries.id_remainder(5) != 0)
    model = toxicity.CharacterModel.of(toxicity.character_counts(docs))
    return docs, model, toxicity.fit(docs, labels, model)


def test_counts_add_up_whatever_the_batches(spark, learnt):
    docs, _, _ = learnt
    texts = [r.text for r in docs.limit(50).collect()]
    three, four = np.zeros(1 << 18, np.int64), np.zeros(toxicity.GRAMS, np.int64)
    for t in texts:
        toxicity.gram_counts([t], three, four)
    other3, other4 = np.zeros_like(three), np.zeros_like(four)
    toxicity.gram_counts(texts, other3, other4)
    assert abs(int(three.sum()) - int(other3.sum())) <= 2 * len(texts) and (three[64:] == other3[64:]).mean() > 0.99
    history = three[: 1 << 18].reshape(-1, 64).sum()
    assert history == three.sum() and four.sum() == three.sum()


def test_viterbi_is_the_best_of_all_paths(learnt):
    restorer = toxicity.Restorer(learnt[1])
    for text in ("1d10t", "a.b-c", "sc4m!", "tttoo0", "l|ke"):
        places = [*restorer.lattice(text, False), [(" ", 0.0)]]

        def walk(at, history, out):
            if at == len(places):
                return 0.0, out
            best = (-1e9, "")
            for said, cost in places[at]:
                if not said:
                    value, rest = walk(at + 1, history, out)
                elif said == " ":
                    ended = history & 63 == 0
                    value, rest = walk(at + 1, 0, out if ended else out + " ")
                    value += 0.0 if ended else learnt[1].log(history, 0)
                else:
                    s = restorer.symbol[said]
                    value, rest = walk(at + 1, (history << 6 | s) & 0x3FFFF if history & 63 else s, out + said)
                    value += learnt[1].log(history, s)
                best = max(best, (value - cost, rest))
            return best

        assert restorer.decode(text) == walk(0, 0, "")[1].strip()


def test_disguises_are_seen_through(learnt):
    restorer = toxicity.Restorer(learnt[1])
    right = sum(restorer.text(f"the {a} of").replace(" ", "") .startswith(f"the{b}") for a, b in DISGUISED.items())
    assert right >= len(DISGUISED) - 1
    assert restorer.text("Plain words, and 2023 \n numbers.") == "Plain words, and 2023 \n numbers."


def test_disguised_documents_score_as_plain_ones(spark, learnt):
    docs, model, classifier = learnt
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [r for r in docs.collect() if labels.get(r.doc_id) == 0][:40]
    rng = random.Random(5)
    insults = ["1d10t", "m0r0n", "$tup1d", "i d i o t", "tr@sh", "sc-um"]
    planted = [(r.doc_id, " ".join(w + (f" {rng.choice(insults)}" if k % 12 == 3 else "") for k, w in enumerate(r.text.split()))) for r in clean]
    scored = lambda rows: toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model, classifier).collect()
    assert sum(r.predicted for r in scored(planted)) >= 36
    assert sum(r.predicted for r in scored([(r.doc_id, r.text) for r in clean])) <= 2


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in text_queries.op1_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert len(got) == 1000 and sum(p == t for p, t in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_of_odd_rows(spark, learnt):
    _, model, classifier = learnt
    rows = [(1, None), (2, ""), (3, "?? 12"), (None, "idiot moron scum trash"), (1, "idiot moron scum trash"), (4, "a " * 60_000 + "x" * 60_000)]
    df = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.predicted) for r in toxicity.score_texts(df, model, classifier).collect())
    assert got == [(0, 1), (1, 0), (1, 1), (2, 0), (3, 0), (4, 0)]
    kept = toxicity.keep_clean(df, model, classifier)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    restored = {r.text for r in toxicity.restore_texts(df.where("doc_id < 4"), model).collect()}
    assert {None, ""} <= restored
    empty = df.limit(0)
    nothing = toxicity.CharacterModel.of(toxicity.character_counts(empty))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    untaught = toxicity.fit(empty, labels, nothing)
    assert {r.predicted for r in toxicity.score_texts(df, nothing, untaught).collect()} == {0}
    assert toxicity.score_texts(empty, model, classifier).count() == 0


def test_sample_takes_each_text_once(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)] + [(None, "text 0")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(70)] + [(5, 1), (6, None)], "doc_id long, toxic int")
    sample = sorted(tuple(r) for r in toxicity.labelled_sample(df, labels, 100).collect())
    assert sample == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0)]
    assert toxicity.labelled_sample(df, labels, 2).count() == 4


def test_a_cut_sample_predicts_as_the_natural_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    taught, held = labels.where(text_queries.id_remainder(5) != 0), labels.where(text_queries.id_remainder(5) == 0)
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").transform(cut_lineage)
    model = toxicity.CharacterModel.of(toxicity.character_counts(docs))
    toxic = {r.doc_id: r.toxic for r in held.collect()}
    rows = docs.join(held.select("doc_id"), "doc_id", "left_semi").transform(cut_lineage)
    once = toxicity.labelled_texts(docs, taught).transform(cut_lineage)
    cut = once.where("toxic = 1").count()  # 1:1 from here on
    assert toxicity.label_weights(once, cut)[0] > 5 and toxicity.label_weights(once, cut)[1] == 1
    hits, seen = [], []
    for per_label in (1 << 20, cut):
        classifier = toxicity.fit(docs, taught, model, per_label=per_label)
        predicted = {r.doc_id: r.predicted for r in toxicity.score_texts(rows, model, classifier).collect()}
        seen.append(predicted)
        hits.append([sum(p for i, p in predicted.items() if toxic[i] == v) for v in (0, 1)])
    clean = sum(v == 0 for v in toxic.values())
    print("clean and toxic documents predicted toxic:", hits, "of", clean, len(toxic) - clean)
    assert abs(hits[1][0] - hits[0][0]) <= 0.02 * clean
    assert sum(seen[0][i] == p for i, p in seen[1].items()) >= 0.95 * len(toxic)


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = text_queries.op9_language(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97


def test_rare_languages_are_learnt_whatever_the_size(spark):
    rows = [(i, "the cat and the dog" if i % 500 else "les chats et les chiens", "fr" if i % 500 == 0 else "en") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample_rows=20)
    assert model.languages == ["en", "fr"]
    assert all(r.lang_pred == "fr" and r.score >= 0.5 for r in language.predict_texts(df.where("lang = 'fr'"), model).collect())
    counted = language.fit(df, sample_rows=600).words["the"]
    assert counted[0] > counted[1]


def test_words_back_off_to_shorter_grams():
    rows = [("en", "the", 10), ("fr", "les", 10), ("en", "\tthe", 10), ("en", "\tt", 5), ("fr", "\tt", 1), ("fr", "\tes$", 8), ("en", "\tes$", 1)]
    model = language.Model(rows)
    assert model.languages == ["en", "fr"]
    assert model.of_word("the").argmax() == 0 and model.of_word("les").argmax() == 1
    assert model.of_word("zes").argmax() == 1  # the three letters at its end
    assert model.of_word("t").argmax() == 0 and model.of_word("q") is None
    assert model.predict("les les the")[0] == "fr"
    assert model.predict("12 !?") == ("und", 0.0)


def test_language_of_odd_rows(spark):
    rows = [(1, "the the cat", "en"), (2, "les chat les", "fr"), (3, None, "fr"), (4, "", None), (5, "12 ?", "en"), (None, "the cat", None), (1, "les les les", None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    model = language.fit(df.union(df).select("doc_id", "lang", "text"))
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict_texts(df, model).collect())
    assert got == [(0, "en"), (1, "en"), (1, "fr"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")]
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2]
    untaught = language.fit(df.limit(0).select("doc_id", "lang", "text"))
    assert {(r.lang_pred, r.score) for r in language.predict_texts(df, untaught).collect()} == {("und", 0.0)}


def test_more_languages_than_any_bound(spark):
    words = {f"l{k:03d}": f"{chr(97 + k % 26)}{chr(97 + k // 26)}ka {chr(97 + k % 26)}{chr(97 + k // 26)}mo" for k in range(300)}
    df = spark.createDataFrame([(k, text, lang) for k, (lang, text) in enumerate(words.items())] * 3, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert len(model.languages) == 300 and len(model.words.names) == 600
    got = {r.doc_id: r.lang_pred for r in language.predict_texts(df, model).collect()}
    assert got == dict(enumerate(words))


def test_predictions_equal_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    counts = {}
    for _ in range(120):
        lang, w, n = rng.choice(["x", "y", "z"]), word(), rng.randint(1, 9)
        for item in [w, *("\t" + g for size in range(1, 6) for g in language.grams(w, size))]:
            counts[lang, item] = counts.get((lang, item), 0) + n
    model = language.Model([(lang, item, n) for (lang, item), n in counts.items()])

    def logs(item):
        kind = {i for _, i in counts if i.startswith("\t") == item.startswith("\t")}
        return [math.log((counts.get((lang, item), 0) + 0.5) / sum(counts.get((lang, i), 0) + 0.5 for i in kind)) for lang in "xyz"]

    def of_word(w):
        if any((lang, w) in counts for lang in "xyz"):
            return logs(w)
        for size in range(5, 0, -1):
            known = [logs("\t" + g) for g in language.grams(w, size) if any((lang, "\t" + g) in counts for lang in "xyz")]
            if known:
                return [sum(c) / len(known) for c in zip(*known)]

    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) + rng.choice(["", " qq 7"]) for _ in range(60)] + [None, "", "q"]
    for text, lang, score in zip(texts, *model.predict_all(texts)):
        words = language.WORD((text or "").lower())
        values = [v for v in map(of_word, words) if v]
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        sums = [sum(c) for c in zip(*values)] if values else [0.0] * 3
        best = max(sums)
        want = 1 / sum(math.exp((s - best) / max(len(values), 1) * min(len(values), 12)) for s in sums)
        assert abs(score - want) < 1e-5 and sums["xyz".index(lang)] > best - 1e-4


def test_pieces_are_bounded_in_rows_and_bytes():
    import pyarrow as pa

    from tidemark.llm.text_map import pieces_of

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 700 + ["y" * 50_000] * 9), pa.array(range(709))], names=["t", "n"])
    parts = list(pieces_of(batch, 512, 100_000))
    assert sum(p.num_rows for p in parts) == 709 and [n for p in parts for n in p.column(1).to_pylist()] == list(range(709))
    assert all(p.num_rows == 1 or p.nbytes <= 100_000 for p in parts)


def test_names_decide_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(language.xxhash, "xxh64_intdigest", lambda item: len(item))
    model = language.Model([("a", w, 3) for w in ("ab", "cd", "ef", "xyz")] + [("b", "cd", 9)])
    names = model.words.names.to_pylist()
    assert [names[k] if k >= 0 else None for k in model.words.find(["cd", "xyz", "zz", "ab", "q", "ef"])] == ["cd", "xyz", None, "ab", None, "ef"]
