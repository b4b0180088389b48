"""Code similarity, sampled pairs, and code scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import codes as C
from tidemark.operators.windows import WindowSpec

# six documents with invented codes that share levels in different depths
ROWS = [
    (1, 0, "D05B3/07"), (1, 1, "D05B3/7"), (2, 0, "H02K11/21"), (3, 0, "D05C1/02"), (3, 1, "E21B7/12"),
    (3, 2, "E21B7/12"), (4, 0, "E21B7/18"), (5, 0, "G09G5/006"), (5, 1, "H02K15/21"), (6, 0, "C12N9/88"),
]


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(ROWS, "pat long, progr int, CPC string")


def level(a, b):
    la = [*a[:4], *a[4:].split("/")]
    lb = [*b[:4], *b[4:].split("/")]
    same = next((i for i in range(6) if la[i] != lb[i]), 6)
    return 1.0 if same == 6 else 1 - (2 / 3) ** same


def similarity(a, b):
    m = np.array([[level(x, y) for y in b] for x in a])
    return np.concatenate([m.max(axis=0), m.max(axis=1)]).mean()


def by_doc():
    out = {}
    for pat, _, code in ROWS:
        out.setdefault(pat, []).append(code)
    return out


def test_similarity_of_all_pairs(spark, codes):
    ids = codes.select(F.col("pat").alias("patent"), F.lit("g").alias("g")).distinct()
    got = C.pair_code_similarity(C.sample_pairs(ids, ["g"], 10), codes).collect()
    docs = by_doc()
    assert len(got) == 15
    for r in got:
        assert r["i"] < r["j"] and r["correlation"] == pytest.approx(similarity(docs[r["i"]], docs[r["j"]]))


def test_same_and_unknown_documents(spark, codes):
    pairs = spark.createDataFrame([(1, 1), (0, 0), (0, 1)], "i long, j long")
    got = {(r["i"], r["j"]): r["correlation"] for r in C.pair_code_similarity(pairs, codes).collect()}
    assert got == {(1, 1): 1.0, (0, 0): 1.0, (0, 1): None}
    with pytest.raises(Exception, match="no codes"):
        C.require_known(C.pair_code_similarity(pairs, codes)).collect()


def test_pairs_are_dealt_once_before_their_lists_join(spark, codes):
    """The pairs are dealt by i for the first list and by j for the second, and no third time."""
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "i long, j long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.pair_code_similarity(pairs, codes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(i#" in x or "Exchange hashpartitioning(j#" in x]
    by_i = [x for x in dealt if "hashpartitioning(i#" in x and ", j#" not in x]
    assert not any("(i#" in x and ", j#" in x for x in dealt) and len(by_i) <= 2


@pytest.mark.parametrize("k, n", [(2, 12), (3, 18), (4, 24), (5, 15), (10, 15)])
def test_pair_counts(spark, codes, k, n):
    ids = codes.select(F.col("pat").alias("patent"), F.lit("g").alias("g")).distinct()
    pairs = C.sample_pairs(ids, ["g"], k, 3)
    assert pairs.count() == pairs.distinct().count() == n
    assert pairs.where("i = j").count() == 0


def test_too_few_documents(spark):
    one = spark.createDataFrame([("g", 1)], "g string, patent long")
    assert C.sample_pairs(one, ["g"], 2).count() == 0
    with pytest.raises(Exception, match="need 2 documents"):
        C.sample_pairs(one, ["g"], 2, min_docs=2).collect()


@pytest.mark.parametrize("method", [None, "blocks"])
def test_code_scores(spark, method):
    rng = np.random.default_rng(1)
    docs = {}
    for pat in range(60):
        n = int(rng.integers(1, 4))
        docs[pat] = [
            f"{'AB'[rng.integers(2)]}{rng.integers(2)}{rng.integers(2)}{'CD'[rng.integers(2)]}{rng.integers(1, 3)}/{rng.integers(2)}"
            for _ in range(n)
        ]
    rows = [(p, i, c) for p, cs in docs.items() for i, c in enumerate(cs)]
    codes = spark.createDataFrame(rows, "pat long, progr int, CPC string")
    years = spark.createDataFrame([(p, 1900 + p % 6) for p in docs], "pat long, year int")
    vectors = C.code_vectors(codes, years)
    exponents = [1.0, 2.0, 3.0, 0.5]
    windows = WindowSpec(1901, 1906, 5, 1).frame(spark)
    got = C.code_novelty_impact(vectors, windows, exponents, rows=7, method=method).collect()
    assert len(got) == 10 * len(exponents)
    for r in got:
        own, p = docs[r["patent"]], r["exponent"]
        mean = lambda test: np.mean([
            np.mean([max(level(c, o) for o in docs[q]) for c in own]) ** p for q in docs if test(1900 + q % 6)
        ]) ** (1 / p)
        back, forward = mean(lambda y: y < 1903), mean(lambda y: 1903 < y <= 1905)
        assert r["back_similarity"] == pytest.approx(back) and r["novelty"] == pytest.approx(1 - back)
        assert r["impact"] == pytest.approx(forward / (back + 1e-12))


def test_malformed_codes_are_counted(spark, codes):
    bad = spark.createDataFrame([(7, 0, "??"), (8, 0, "H02K11/021")], "pat long, progr int, CPC string")
    assert C.malformed_codes(bad).first()["malformed"] == 1
    years = spark.createDataFrame([(7, 1900), (8, 1901)], "pat long, year int")
    got = C.code_vectors(bad, years).collect()
    assert [(r["pat"], r["levels"]) for r in got] == [(8, [72, 0, 2, 75, 11, 21])]


def test_sorted_codes(spark):
    rows = [(2, 1, "b"), (2, 0, "a"), (1, 0, "c"), (3, 0, "d"), (4, 0, "e")]
    codes = spark.createDataFrame(rows, "pat LONG, progr INT, CPC STRING").repartition(4)
    years = spark.createDataFrame([(1, 1905), (2, 1901), (3, 1901)], "pat LONG, year INT")
    assert [r["CPC"] for r in C.sorted_codes(codes, years).collect()] == ["a", "b", "d", "c"]


def brute_score(docs, years, pat, p, test):
    own = docs[pat]
    values = [np.mean([max(level(c, o) for o in docs[q]) for c in own]) ** p for q in docs if test(years[q])]
    return np.mean(values) ** (1 / p) if values else None


def test_code_scores_of_long_and_single_lists(spark):
    rng = np.random.default_rng(5)
    docs, years = {}, {}
    for pat in range(40):
        # thirty codes, one code, and codes that nobody else has
        n, letters = (30, "ABC") if pat % 13 == 5 else (1, "Z") if pat == 9 else (int(rng.integers(1, 4)), "ABC")
        docs[pat] = [
            f"{letters[rng.integers(len(letters))]}{rng.integers(3)}{rng.integers(3)}{'CD'[rng.integers(2)]}{rng.integers(1, 4)}/{rng.integers(3)}"
            for _ in range(n)
        ]
        years[pat] = 1900 + pat % 7
    rows = [(p, i, c) for p, cs in docs.items() for i, c in enumerate(cs)]
    vectors = C.code_vectors(
        spark.createDataFrame(rows, "pat long, progr int, CPC string"),
        spark.createDataFrame(list(years.items()), "pat long, year int"),
    )
    windows = WindowSpec(1900, 1907, 5, 1).frame(spark)
    exponents = [1.0, 2.0, 3.0, 1.5]
    got = C.code_novelty_impact(vectors, windows, exponents, rows=3).collect()
    frames = C.code_frames(windows).collect()
    wanted = {(f["window"], p, d) for f in frames for d in docs if years[d] == f["focal_year"] for p in exponents}
    assert {(r["window"], r["exponent"], r["patent"]) for r in got} == wanted and len(got) == len(wanted)
    ends = {f["window"]: (f["focal_year"], f["end"]) for f in frames}
    for r in got:
        f, end = ends[r["window"]]
        back = brute_score(docs, years, r["patent"], r["exponent"], lambda y: y < f)
        forward = brute_score(docs, years, r["patent"], r["exponent"], lambda y: f < y <= end)
        assert r["back_similarity"] == pytest.approx(back, abs=1e-9)
        assert r["impact"] == pytest.approx(forward / (back + 1e-12))


def test_sets_of_one_year_are_not_grown(spark):
    rows = [(1, 0, "A11B1/1"), (1, 1, "C22D2/2"), (2, 0, "A11B1/1"), (3, 0, "C22D2/2"), (3, 1, "A11B1/1"), (4, 0, "E33F3/3")]
    years = spark.createDataFrame([(1, 1900), (2, 1901), (3, 1902), (4, 1902)], "pat long, year int")
    vectors = C.code_vectors(spark.createDataFrame(rows, "pat long, progr int, CPC string"), years)
    one, two = [{r["key"]: len(r["years"]) for r in t.collect()} for t in C.count_prefix_sets(C.weighted_prefixes(vectors), 2)]
    assert len(one) == 12 and not any(k.startswith("69") for k in one)
    assert len(two) == 36 and set(two.values()) == {2}


def test_equal_lists_are_compared_once(spark):
    """documents of a year with the same codes are one list with their number, whatever the order of the codes."""
    rows = [(i, 1900, k, c) for i in range(40) for k, c in enumerate(["A01B1/2", "H02K3/4"][:: 1 if i % 2 else -1])] + [(99, 1900, 0, "A01B1/2")]
    codes = spark.createDataFrame([(p, k, c) for p, _, k, c in rows], "pat long, progr int, CPC string")
    years = spark.createDataFrame(sorted({(p, y) for p, y, *_ in rows}), "pat long, year int")
    lists, held = C.equal_lists(C.code_vectors(codes, years))
    assert sorted(r["n"] for r in lists.collect()) == [1, 40]
    assert held.count() == 41 and held.select("list").distinct().count() == 2


def test_sums_of_a_pair_of_blocks():
    """codes shared by all, some and no lists, lists of one to nine codes, against every pair of codes."""
    rng = np.random.default_rng(5)
    side = lambda n: (lens := rng.integers(1, 10, n), rng.integers(0, 3, (lens.sum(), 6)), rng.integers(1, 5, n))
    (fl, fc, fn), (rl, rc, rn) = side(50), side(70)
    got = C.block_sums((fl, fc), (rl, rc, rn), [0.5, 1.5, 2.2])
    cut = lambda lens, codes: np.split(codes, np.cumsum(lens)[:-1])
    gain = lambda x, y: 1 - (2 / 3) ** k if (k := int(np.cumprod(x == y).sum())) < 6 else 1.0
    for row, mine in zip(got, cut(fl, fc)):
        means = np.array([np.mean([max(gain(x, y) for y in theirs) for x in mine]) for theirs in cut(rl, rc)])
        assert row == pytest.approx([(means**p * rn).sum() for p in (0.5, 1.5, 2.2)])
