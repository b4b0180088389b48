"""Runs, exact copies and manifests against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_copies, merkle_manifest, periodic_runs, structure_queries

DOCS = "doc_id long, text string, row string, key long, kept int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", -1, 0) for i, t in rows], DOCS).repartition(parts)


def brute_runs(words, least_periods=4, least_words=6):
    found = {}
    for p in range(1, len(words) // least_periods + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least_words, least_periods * p):
                found.setdefault((start, i + p - start), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_digest(key, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (key, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_cover_reaches_every_pair():
    assert periodic_runs.REACH.max() < periodic_runs.V
    inside = set(periodic_runs.COVER.tolist())
    for i in range(16):
        for j in range(16):
            k = int(periodic_runs.REACH[i, j])
            assert (i + k) % 16 in inside and (j + k) % 16 in inside


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 8, 30, 80, 300]), rng.choice([1, 2, 3, 50])
            words = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 8 else 0):
                a, p = rng.randrange(n), 1 + rng.randrange(n // 5 + 1)
                for i in range(a, min(n, a + rng.randint(2, 9) * p)):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        texts += [texts[0]] * rng.randint(0, 2)
        found = periodic_runs.find_runs(
            np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), slice_pairs=rng.choice([3, 100, 1 << 20])
        )
        assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_prefixes_of_samples_equal_brute_force():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.tile(rng.integers(0, 3, 40), 6), rng.integers(0, 3, 200)])
    padded = np.concatenate([words, np.arange(3, 35)])
    samples = periodic_runs.Samples(padded, np.zeros(len(padded), np.int64), len(words))
    places = samples.places[samples.places < len(words)]
    i, j = rng.choice(places, 400), rng.choice(places, 400)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, samples.common(i, j)):
        k = 0
        while padded[max(a, b) + k] == padded[min(a, b) + k] and max(a, b) + k < len(padded) - 1:
            k += 1
        assert n == k


def test_run_digests_of_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a"), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (5, "a a a a a"),
        (6, "x " * 1_500 + "y"), (7, "a b " * 9), (8, "\x1ca \x1ca \x1ca \x1ca \x1ca \x1ca"), (9, "ab " * 3 + "cd " * 8 + "ab " * 7),
        (10, "é" * 70_000), (11, "\x00 " * 12),
    ]
    found = structure_queries.periodic_runs.run_digests(frame(spark, rows), prepare=structure_queries.made_periodic).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(brute_digest(*r)) for r in rows)
    assert periodic_runs.run_digests(frame(spark, [])).count() == 0
    collapsed = {r["doc_id"]: r for r in periodic_runs.collapse_runs(frame(spark, rows)).collect()}
    assert collapsed[9]["collapsed"] == "ab ab ab cd ab" and [tuple(r) for r in collapsed[9]["runs"]] == [(3, 8, 1), (11, 7, 1)]
    assert collapsed[1]["collapsed"] is None and collapsed[2]["collapsed"] == ""


def test_op11_equals_brute_force(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()
    assert len(texts) > 150
    found = {r["doc_id"]: tuple(r) for r in structure_queries.op11_periodic_runs(spark, sf).collect()}
    assert all(found[r["doc_id"]] == brute_digest(*r) for r in texts)


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        members.sort()
        for place, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), place == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(map(repr, out))


def copies():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for i in range(300)]
    rows += [(1000 + i, rng.choice(["the one", "theone", "the  one\n", "th eone"])) for i in range(200)]
    rows += [(None, "the one"), (None, "the    one"), (None, "the    one"), (7, None), (7, ""), (1, "z" * 100_000), (2, "z" * 99_999 + " z")]
    return rows + rows[300:310]


@pytest.mark.parametrize("options", [{}, {"capacity": 20, "deepest": 8}, {"capacity": 1, "deepest": 3, "hot_rows": 0}])
def test_exact_groups_equal_brute_force(spark, options):
    found = exact_copies.exact_groups(frame(spark, copies()), **options).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute_copies(copies())


def test_exact_groups_of_nothing(spark):
    assert exact_copies.exact_groups(frame(spark, []), capacity=1, hot_rows=0).count() == 0
    found = exact_copies.exact_groups(frame(spark, [(None, None)] * 3), hot_rows=1).collect()
    assert [r["group_size"] for r in found] == [3] * 3 and sum(r["kept"] for r in found) == 1


def test_texts_that_share_a_key_part_ways(spark, monkeypatch):
    monkeypatch.setattr(exact_copies.F, "xxhash64", lambda c: F.length(c).cast("long") * F.lit(1 << 40))
    rows = [(i, t) for i, t in enumerate(["ab", "a b", "cd", "c d", "xyz", "cd"] * 4)]
    for hot in (0, 100):
        found = exact_copies.exact_groups(frame(spark, rows), capacity=1, deepest=4, hot_rows=hot).collect()
        assert sorted(repr(tuple(r)) for r in found) == brute_copies(rows)


def test_directory_holds_its_rules(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(40).select((F.col("id") * 3 + (1 << 60)).alias("key")))
    slots, depth = exact_copies.build_directory(keys, 40, deepest=9)
    rows = slots.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1 << depth))
    buckets = {}
    for r in rows:
        buckets.setdefault(r["bucket"], []).append(r)
    for first, members in buckets.items():
        assert first == members[0]["slot"] and len(members) == 1 << (depth - members[0]["depth"])
        assert members[0]["n"] <= 40 or members[0]["depth"] == 9
    assert sum(m[0]["n"] for m in buckets.values()) == 5040 and depth == 9


def test_op12_uses_no_python(spark, sf):
    plan = structure_queries.op12_exact_copies(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """(top, siblings of each leaf from the bottom up, for folding: (before, after) by level)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            start = at // 16 * 16
            paths[leaf].append((nodes[start:at], nodes[at + 1 : start + 16]))
            places[leaf] = at // 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        small = r[:4] + (None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4]),)
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        leaf = h(*map(field, r))
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, h(*map(field, small)) if tampered else leaf, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = brute_tree([m[2] for m in groups[name]])
    root, upper = brute_tree([trees[n][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for m, path in zip(groups[name], trees[name][1]):
            path, digest = path + upper[place], m[3]
            for before, after in path:
                digest = h(*before, digest, *after)
            proof = h(*("".join(b + a) for b, a in path))
            out.append((m[4], m[2], trees[name][0], root, proof, digest, digest == root))
    return sorted(map(repr, out))


LEAF = "doc_id long, source string, lang string, n_chars int, text string, grp string, idx long, size int, digest string"


def proved(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], LEAF).repartition(3)
    return merkle_manifest.manifest(
        df, structure_queries.FIELDS, changed={"text": F.translate("text", structure_queries.UPPER, structure_queries.LOWER)},
        when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **options,
    )


def manifest_rows(sources, seed=0):
    rng = random.Random(seed)
    rows = []
    for n, source in sources:
        rows += [(rng.randrange(10**6), source, rng.choice(["en", None, "é"]), rng.choice([None, 5]), rng.choice([None, "", "Ab c", "ab c", "É A"])) for _ in range(n)]
    return rows


@pytest.mark.parametrize(
    "sources, options",
    [
        ([(1, "a")], {}), ([(1, None), (2, "")], {}), ([(600, "big"), (17, "b"), (16, "é"), (1, "z"), (300, None)], {"block_size": 100}),
        ([(300, "x"), *((k % 3 + 1, f"s{k}") for k in range(40))], {"block_size": 7, "wide": 3}), ([(257, "y")], {"block_size": 1, "wide": 0}),
    ],
)
def test_manifest_equals_brute_force(spark, sources, options):
    rows = manifest_rows(sources)
    rows += rows[:2] + [(None, s, None, None, t) for _, s in sources[:1] for t in (None, "a", "a")]
    assert sorted(repr(tuple(r)) for r in proved(spark, rows, **options).collect()) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert proved(spark, []).count() == 0


def test_missing_is_the_least_set():
    rng = np.random.default_rng(1)
    for size in (1, 2, 16, 17, 256, 300, 5000):
        own = np.unique(rng.integers(0, size, rng.integers(1, 40)))
        needed = merkle_manifest.missing(own, size)
        held = own
        for width, found in zip(merkle_manifest.heights(size), needed):
            runs = np.unique(held // 16)
            for r in runs:
                members = set(range(r * 16, min(r * 16 + 16, width)))
                assert members - set(held.tolist()) == members & set(found.tolist())
            assert set(found.tolist() + held.tolist()) == {i for r in runs for i in range(r * 16, min(r * 16 + 16, width))}
            held = runs
        assert held.tolist() == [0]
