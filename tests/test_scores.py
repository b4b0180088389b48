"""Scores against brute force, and the distributed ranks behind them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import exact_sum
from tidemark.operators import blocks as B, ranking as R, scores as S, skew, windows as W
from tidemark.operators.embed import unit_rows
from tidemark.operators.grading import model_grades, pair_similarity, pair_similarity_sparse, spearman
from tidemark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [("m", i, 1900 + i % 7, rng.normal(size=5).tolist()) for i in range(84)]
    rows.append(("m", 84, 1903, [0.0] * 5))
    return spark.createDataFrame(rows, "model string, patent long, year int, embedding array<double>")


def members(vectors, spec):
    return W.assign_windows(vectors.select("patent", "year"), spec.frame(vectors.sparkSession)).select(
        "window", "patent", "year"
    )


def brute(vectors, focal, near, far, p):
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows])
    length = np.linalg.norm(x, axis=1)
    x = x / np.where(length > 0, length, 1)[:, None]
    year, ids = np.array([r["year"] for r in rows]), np.array([r["patent"] for r in rows])
    gap = year - focal
    out = {}
    for i in np.where(gap == 0)[0]:
        mean = lambda side: np.mean(((1 + x[side] @ x[i]) / 2) ** p) ** (1 / p)
        back, forward = mean((gap <= -near) & (gap >= -far)), mean((gap >= near) & (gap <= far))
        out[int(ids[i])] = (1 - back, forward / (back + 1e-12))
    return out


@pytest.mark.parametrize("method", [None, "blocks"])
def test_scores_match_all_pairs(spark, vectors, method):
    docs = members(vectors, W.WindowSpec(1900, 1907, 7, 1))
    got = S.novelty_impact(vectors, docs, [1, 2, 3, 1.5], method=method, rows=5).collect()
    for p in (1.0, 2.0, 3.0, 1.5):
        want = brute(vectors, 1903, 1, 3, p)
        rows = {r["patent"]: r for r in got if r["exponent"] == p}
        assert set(rows) == set(want)
        for patent, (novelty, impact) in want.items():
            assert rows[patent]["novelty"] == pytest.approx(novelty, abs=1e-12)
            assert rows[patent]["impact"] == pytest.approx(impact, abs=1e-12)


def test_reach(spark, vectors):
    docs = members(vectors, W.WindowSpec(1900, 1907, 7, 1))
    got = {r["patent"]: r["novelty"] for r in S.novelty_impact(vectors, docs, 2.0, reach=(2, 3)).collect()}
    want = brute(vectors, 1903, 2, 3, 2.0)
    assert got == {k: pytest.approx(v[0], abs=1e-12) for k, v in want.items()}


@pytest.mark.parametrize("method", [None, "blocks"])
def test_empty_side_gives_null(spark, vectors, method):
    docs = members(vectors, W.WindowSpec(1900, 1907, 1, 1))
    got = S.novelty_impact(vectors, docs, [1, 0.5], method=method)
    assert got.count() == 2 * 85 and got.where("novelty IS NOT NULL OR impact IS NOT NULL").count() == 0


def test_sparse_equals_dense(spark, vectors):
    docs = members(vectors, W.WindowSpec(1900, 1907, 5, 1))
    own = docs.join(vectors.drop("year"), "patent")
    long = own.select("model", "window", "patent", F.posexplode("embedding").alias("term", "w"))
    long = long.where("w <> 0").withColumn("term", F.col("term").cast("string"))
    key = ["window", "patent", "exponent"]
    dense = {tuple(r[k] for k in key): r for r in S.novelty_impact(own, docs, [1.0, 2.0]).collect()}
    sparse = S.novelty_impact_sparse(long, docs, [1.0, 2.0], rows=7).collect()
    assert len(sparse) == len(dense)
    for r in sparse:
        assert r["impact"] == pytest.approx(dense[tuple(r[k] for k in key)]["impact"], abs=1e-12)
    a = {(r["window"], r["delta"]): r["autocorrelation"] for r in S.autocorrelation(own, docs, rows=6).collect()}
    b = S.autocorrelation(long, docs, rows=9, sparse=True).collect()
    assert len(a) == len(b)
    assert all(r["autocorrelation"] == pytest.approx(a[r["window"], r["delta"]], abs=1e-12) for r in b)


def test_sparse_terms_of_one_document_add_up(spark):
    """Full, common, rare and repeated terms, in one block and in many, against all pairs."""
    rng = np.random.default_rng(3)
    share = np.repeat([0.9, 0.4, 0.02], [3, 12, 60])
    dense = {k: rng.normal(size=75) * (rng.random(75) < share) for k in range(180)}
    dense[7][:] = 0.0
    docs = spark.createDataFrame([("w", k, 1900 + k % 3) for k in dense], "window string, patent long, year int")
    terms = [("m", "w", k, str(t), float(x)) for k, v in dense.items() for t, x in enumerate(v) if x]
    halves = [(*r[:4], r[4] / 2) for r in terms for _ in "ab"]  # a document's terms may come in several rows
    unit = np.stack([v / (np.sqrt((v * v).sum() / 2) or 1.0) for v in dense.values()])  # its length is taken over all of them
    similar = np.maximum((1 + unit @ unit.T) / 2, 0.0)
    for rows in (None, 11):
        long = spark.createDataFrame(halves, "model string, window string, patent long, term string, w double")
        got = S.novelty_impact_sparse(long, docs, [2.0, 2.5], rows=rows).collect()
        assert len(got) == 2 * 60
        for r in got:
            k, p = r["patent"], r["exponent"]
            back, forward = (np.mean(similar[k, side::3] ** p) ** (1 / p) for side in (0, 2))
            assert r["novelty"] == pytest.approx(1 - back, abs=1e-12)
            assert r["impact"] == pytest.approx(forward / (back + 1e-12), abs=1e-9)


def test_cached_scores_are_not_recomputed(spark):
    schema = "model string, window string, exponent double, focal_year int, patent long, novelty double, impact double"
    stored = spark.createDataFrame([("m", "a", 1.0, 1, 1, 0.1, 1.0), ("m", "b", 1.0, 1, 2, 0.1, 1.0)], schema)
    wanted = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 1.0), ("m", "b", 2.0)], "model string, window string, exponent double")
    asked = []

    def compute(missing):
        asked.extend((r["model"], r["window"]) for r in missing.collect())
        return stored.where("window = 'b'").withColumn("novelty", F.lit(9.0))

    got = {r["window"]: r["novelty"] for r in S.scores_cached(wanted, stored, compute).collect()}
    assert asked == [("m", "b")] and got == {"a": 0.1, "b": 9.0}


def test_wide(spark, vectors):
    docs = members(vectors, W.WindowSpec(1900, 1907, 7, 1))
    wide = S.scores_wide(S.novelty_impact(vectors, docs, [1, 2, 3]))
    assert wide.columns[2:] == ["impact-1.0", "novelty-1.0", "impact-2.0", "novelty-2.0", "impact-3.0", "novelty-3.0"]
    assert wide.count() == 13


def test_positions_cross_buckets(spark):
    keys = [5, 1 << 20, 3, (1 << 35) + 1, 1 << 35, 70000, 0]
    rows = spark.createDataFrame([("g", k) for k in keys] + [("h", 9)], "g string, k long")
    got = R.with_position(rows, ["g"], "k").where("g = 'g'").orderBy("pos").collect()
    assert [r["k"] for r in got] == sorted(keys) and [r["pos"] for r in got] == list(range(7))


def test_ranks_and_spearman_with_ties(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(-3, 4, 300) / 7 * 1e5, rng.normal(size=300) * 1e-9
    y[:100] = 0.0
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")

    def rank(v):
        return np.array([np.sum(v < a) + (np.sum(v == a) + 1) / 2 for a in v])

    want = np.corrcoef(rank(x), rank(y))[0, 1]
    assert spearman(rows, ["g"], "x", "y").first()["spearman"] == pytest.approx(want, abs=1e-12)
    assert spearman(rows.withColumn("y", F.lit(1.0)), ["g"], "x", "y").first()["spearman"] is None


def test_hot_keys_are_split_without_changing_the_join(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("patent"))
    many = many.withColumn("k", F.when(F.col("patent") < 900, 0).otherwise(F.col("k")))
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("inner", "left"):
        plain = many.join(one, "k", how)
        salted = skew.skew_join(many, one, ["k"], how, min_rows=10)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(*salted.columns).collect()))
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.hot_keys(counts, ["k"], min_rows=100).collect()[0]["_salts"] > 1


def test_grades_of_dense_and_sparse_agree(spark):
    vectors = spark.createDataFrame(
        [("m", "1900-1902", i, [float(i % 2), float(i % 3)]) for i in range(6)],
        "model string, window string, patent long, embedding array<double>",
    )
    pairs = spark.createDataFrame(
        [("1900-1902", i, (i + 1) % 6, i / 10) for i in range(6)], "window string, i long, j long, correlation double"
    )
    long = vectors.select("model", "window", "patent", F.posexplode("embedding").alias("term", "w")).where("w <> 0")
    long = long.withColumn("term", F.col("term").cast("string"))
    a = model_grades(pair_similarity(pairs, vectors)).first()
    b = model_grades(pair_similarity_sparse(pairs, long)).first()
    assert a["spearman"] == pytest.approx(b["spearman"]) and a["year"] == 1901.0


def test_window_spec(spark):
    spec = W.WindowSpec(1901, 1912, 5, 3)
    assert [(r["start"], r["end"]) for r in spec.frame(spark).orderBy("start").collect()] == [
        (1901, 1905), (1904, 1908), (1907, 1911)
    ]
    assert W.WindowSpec(1900, 1950, 11).step == 6
    assert spec.name == "s1838-w5-c10-dNone-nNone"
    names = spark.createDataFrame([("1900-1910",), ("1900",), ("window_1",), ("a-b-c",)], "w string")
    assert [r[0] for r in names.select(W.plot_year(F.col("w"))).collect()] == [1905.0, 1900.0, None, None]
    labels = [tuple(r) for r in names.select(W.plot_label(F.col("w")), "w").collect()]
    assert [a for a, _ in labels[:2]] == ["1905.0", "1900.0"] and all(a == b for a, b in labels[2:])


@pytest.mark.parametrize("name", ["scores_wide", "focal_range_join"])
def test_vectors_are_read_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [vec_id") <= 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_slabs_hold_the_sums_of_powers(order):
    rng = np.random.default_rng(4)
    u, x = rng.normal(size=(9, 13)), rng.normal(size=(20, 13))
    for budget in (1, 100, 10**6):
        groups = B.slab_groups(13, order, budget)
        assert [g[0] for g in groups[1:]] == [g[1] for g in groups[:-1]] and groups[0][0] == 0 and groups[-1][1] == 13
        sums = [B.slab_sums(x, *g, order) for g in groups]
        sizes = [1 + sum(B.slab_size(13, i, order) for i in range(*g)) for g in groups]
        assert [len(s) for s in sums] == sizes and all(s[0] == 20 for s in sums)
        assert all(size <= budget + 1 or g[1] - g[0] == 1 for size, g in zip(sizes, groups))
        found = sum(B.slab_powers(u, s, *g, order) for s, g in zip(sums, groups))
        want = np.stack([((u @ x.T) ** k).sum(1) for k in range(1, order + 1)], 1)
        assert np.allclose(found, want, atol=1e-9)


def test_moments_of_many_parts_and_slabs(spark, vectors, monkeypatch):
    docs = members(vectors, W.WindowSpec(1900, 1907, 5, 1))
    one = {tuple(r[:5]): tuple(r[5:]) for r in S.novelty_impact(vectors, docs, [1, 2, 3], method="moments").collect()}
    monkeypatch.setattr(S, "SLAB", 8)
    monkeypatch.setattr(B, "ROWS", 2)
    many = S.novelty_impact(vectors, docs, [1, 2, 3], rows=2, method="moments").collect()
    assert len(many) == len(one)
    assert all(tuple(r[5:]) == pytest.approx(one[tuple(r[:5])], abs=1e-12) for r in many)


def test_exact_sums_do_not_depend_on_order(spark):
    rng = np.random.default_rng(5)
    values = [float(x) for x in rng.normal(size=500) * 10.0 ** rng.integers(-9, 6, 500)]
    seen = set()
    for seed in range(5):
        rows = spark.createDataFrame([(float(x),) for x in np.random.default_rng(seed).permutation(values)], "x double").repartition(1 + seed)
        seen.add(rows.agg(exact_sum(F.col("x")).alias("s")).first()["s"])
    assert len(seen) == 1 and abs(seen.pop() - float(np.sum(np.array(values, dtype=np.longdouble)))) < 1e-9


def test_equal_documents_tie_exactly(spark):
    rows = [("m", "w", d, f"t{k}", (1 + k * 0.37) / (3 + k)) for d in (1, 2, 3) for k in (range(40) if d < 3 else range(39, -1, -1))]
    long = spark.createDataFrame(rows, "model string, window string, patent long, term string, w double").repartition(7, "term")
    units = unit_rows(long, ["model", "window", "patent"], "l2")
    pairs = spark.createDataFrame([("w", 1, 2, 0.1), ("w", 1, 3, 0.2), ("w", 2, 3, 0.3)], "window string, i long, j long, correlation double")
    assert len({r["similarity"] for r in pair_similarity_sparse(pairs, units).collect()}) == 1


def test_lag_blocks_hold_as_many_numbers_at_any_dimension(spark, monkeypatch):
    """Few long blocks, or many short ones, give the same sums."""
    from tidemark.operators import scores as S

    rows = [("m", "1900-1901", i, 1900 + i % 2, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "model string, window string, patent long, year int, embedding array<double>")
    members = vectors.select("window", "patent", "year")
    found = lambda: {r["delta"]: r["autocorrelation"] for r in S.autocorrelation(vectors.drop("year"), members).collect()}
    long = found()
    monkeypatch.setattr(S, "LAG_BLOCK", 12)  # four vectors
    assert found() == pytest.approx(long) and len(long) > 5


def test_sums_of_blocks_leave_one_at_a_time(spark, monkeypatch):
    """A batch of blocks is never held together with the sums of all of them."""
    kernels = []

    class Rows:
        def mapInPandas(self, kernel, schema):
            kernels.append(kernel)

    monkeypatch.setattr(B, "sum_chunks", lambda df, keys, make=None: make(Rows()) if make else None)
    rows = spark.createDataFrame([(1900, 0, [1], [1.0, 2.0])], "year int, block long, ids array<long>, flat array<double>")
    B.slab_moments(rows, ["year"], [(0, 2)], 3)
    batch = pd.DataFrame({"year": [1900] * 5, "slab": 0, "salt": 0, "n": 1, "flat": [np.array([1.0, 2.0])] * 5})
    out = list(kernels[0](iter([batch])))
    assert [len(f) for f in out] == [1] * 5 and all(list(f["vals"][0]) == list(out[0]["vals"][0]) for f in out)


@pytest.mark.parametrize("full, matches", [(0, 3), (2, 1 << 18), (512, 1)])
def test_products_of_rare_terms_are_made_together(monkeypatch, full, matches):
    """terms that are no full rows are multiplied a bounded number of products at a time, whatever their frequency."""
    import pyarrow as pa

    from tidemark.operators import sparse as SP

    monkeypatch.setattr(SP, "FULL", full)
    monkeypatch.setattr(SP, "MATCHES", matches)
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((90, 12)) < np.linspace(0.02, 0.95, 12), rng.normal(size=(90, 12)), 0.0)
    rows = [[(f"t{t}", x[t]) for t in np.flatnonzero(x)] for x in dense]
    kind = pa.list_(pa.string()), pa.list_(pa.float64())
    batch = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows))), pa.array([[t for t, _ in r] for r in rows], kind[0]), pa.array([[w for _, w in r] for r in rows], kind[1]),
         pa.array([1 + i % 2 for i in range(len(rows))])], names=["patent", "terms", "ws", "kind"],
    )
    index, sums = SP.FocalIndex([batch(rows[:70])]), np.zeros((1, 2, 70))
    SP.add_range(index, batch(rows[70:]), sums, [2.0])
    want = np.maximum((1 + dense[70:] @ dense[:70].T) / 2, 0) ** 2
    assert sums[0][0] == pytest.approx(want[0::2].sum(axis=0)) and sums[0][1] == pytest.approx(want[1::2].sum(axis=0))


def test_lengths_of_sparse_rows_are_taken_once(spark):
    """the length of a document is evaluated once, not once for each of its terms."""
    rows = spark.range(3).selectExpr("'m' AS model", "'w' AS window", "id AS patent", "transform(sequence(0, 5), t -> struct(string(t) AS term, double(t * id) AS w)) AS v")
    got = S.unit_docs(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" in plan and "transform(v" not in plan.split("Aggregate [")[0]
    found = {r["patent"]: r["ws"] for r in got.collect()}
    assert set(found) == {1, 2} and all(ws == [t * p / math.sqrt(55.0 * p * p) for t in range(6)] for p, ws in found.items())
