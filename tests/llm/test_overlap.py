"""Contamination and near duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import contamination, near_join, overlap_queries
from tidemark.llm.contamination import WORD

DOCS = "doc_id long, text string, class_id string, item_id long, band int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", -1, 0) for i, t in rows], DOCS)


def gram_set(text, n=5):
    words = near_join.WORD((text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(rows):
    """Brute force: id -> (class, set, copies, links)."""
    sets = {}
    for i, t in rows:
        if i is not None and gram_set(t):
            sets.setdefault(gram_set(t), set()).add(i)
    root = {s: min(ids) for s, ids in sets.items()}
    linked = {s: set() for s in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            linked[a].add(b)
            linked[b].add(a)
    while True:
        new = {s: min([root[s], *(root[o] for o in linked[s])]) for s in sets}
        if new == root:
            break
        root = new
    out = {}
    for i in {i for i, _ in rows if i is not None}:
        own = [gram_set(t) for j, t in rows if j == i and gram_set(t)]
        out[i] = (min([root[s] for s in own], default=i), min([min(sets[s]) for s in own], default=i),
                  max([len(sets[s]) for s in own], default=1), max([len(linked[s]) for s in own], default=0))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy).title() + rng.choice(["", ".", " !"])))
            n += 1
    hot = [word() for _ in range(80)]
    for k in range(40):  # one large group of near copies
        copy = list(hot)
        copy[k % 80] = word()
        rows.append((n, " ".join(copy)))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "?! ."), (None, rows[0][1]), (3, "one two three"), (3, rows[5][1]), (n + 3, "x " * 5000)]


@pytest.mark.parametrize("block", [256, 7])
def test_near_join_is_brute_force(spark, block):
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:] for r in near_join.near_join(frame(spark, rows), block=block).collect()}
    assert got == classes(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(2)
    # each distinct text of a repeated id is a document of its own; numbered by id, the lowest of a class is one of the lowest id
    docs = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    want = {n: v[0] for n, v in classes([(n, t) for n, (_, t) in enumerate(docs)]).items()}
    kept = near_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "class_id", "item_id", "band"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    named = [r for r in got if r[0] is not None]
    assert [r for r in got if r[0] is None] == [r for r in rows if r[0] is None]
    assert sorted(i for i, _ in named) == sorted(docs[n][0] for n, c in want.items() if n == c)
    assert sorted(want[docs.index(r)] for r in named) == sorted(set(want.values()))


def test_near_join_of_nothing(spark):
    assert near_join.near_join(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_join.near_join(frame(spark, [(4, None), (4, None)])).collect()] == [(4, 4, 4, 1, 0)]


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.9)):
        bands, rows = near_join.choose_bands(s, recall, 128)
        assert bands * rows <= 128 and 1 - (1 - s**rows) ** bands >= recall
    assert near_join.choose_bands(0.01, 0.999, 16) == (16, 1)


def test_shared_counts_in_slabs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))).astype(np.uint64) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) if a is not b else None for b in sets] for a in sets]
    for width in (20, 64, 1 << 22):
        got = near_join.shared_counts(sets, width)
        assert all(w is None or got[i, j] == w for i, row in enumerate(want) for j, w in enumerate(row))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.low for r in near_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def bm25_share(index, window, item):
    terms = {index.terms[w] for w in window if w in index.terms}
    return sum(w for t in terms for i, w in zip(index.postings[t].items, index.postings[t].weights) if i == item)


def benchmark(seed=3, n=70):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, f"{text(rng.randrange(8, 30))}. {text(rng.randrange(3, 8))}.") for i in range(n)]
    return items, text


def test_search_finds_all_above_the_threshold():
    items, text = benchmark()
    words = [WORD(t) for _, t in items]
    df = {w: sum(w in x for x in words) for x in words for w in x}
    index = contamination.Index(items, df, len(items), 20.0)
    assert all(abs(bm25_share(index, w, i) - 1) < 1e-9 for i, w in enumerate(words))
    for threshold in (0.15, 0.3, 0.6):
        for k in range(60):
            window = text(40).split() + (words[k][: 3 + k % 20] if k % 3 else [])
            want = {i: bm25_share(index, window, i) for i in range(len(items))}
            got = dict(index.search(sorted({index.terms[w] for w in window if w in index.terms}), threshold))
            assert got.keys() == {i for i, s in want.items() if s >= threshold - 1e-6}
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("part_words", [1_000_000, 300])
def test_leaks_are_found_and_clean_texts_are_not(spark, part_words):
    items, text = benchmark()
    rows = [(i, text(200)) for i in range(30)]
    rows += [(100 + i, f"{text(50)} {items[i][1].upper()} {text(1000 * (i % 2))}") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "..."), (None, items[0][1]), (100, items[1][1])]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items] + [(None, items[0][1], ""), (900, None, ""), (901, "", ""), (902, items[2][1], "")],
                                  "item_id long, text string, doc_id string")
    df = frame(spark, rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in contamination.find_leaks(df, bench, part_words=part_words).collect())
    assert got == sorted([*((100 + i, i) for i in range(20)), (102, 902), (-1, 0), (100, 1)])
    kept = contamination.keep_unleaked(df, bench, part_words=part_words)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(30), 200, 201, 202]
    assert contamination.find_leaks(df.limit(0), bench).count() == 0 and contamination.find_leaks(df, bench.limit(0)).count() == 0


def test_query_finds_the_items_that_texts_hold(spark, sf):
    items = [(r.item_id, " ".join(WORD(r.text.lower()))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, " ".join(WORD(r.text.lower()))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in overlap_queries.op2_contamination(spark, sf).collect()}
    assert whole <= got and len(got) <= len(whole) + 2


def test_keep_one_loses_no_text_of_a_repeated_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey")
    rows = [(1, a), (2, a + "!"), (2, b), (3, c), (3, c), (3, c.upper()), (4, b), (None, a), (None, a), (5, None), (5, None), (6, "")]
    kept = near_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([("1", a), ("2", b), ("3", c), ("None", a), ("None", a), ("5", ""), ("6", "")])
