"""Grades of embedding models: rank correlation of embedding and code similarity of document pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.vectors import REST, WHOLE, dot
from tidemark.operators.codes import CELL
from tidemark.operators.packed import FULL, Rows, packer, runs, send
from tidemark.operators.ranking import first_n, tie_averaged_ranks
from tidemark.operators.windows import plot_year
from tidemark.session import cut_lineage, fan_out


def pair_similarity(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """C-8 for dense vectors: raw dot product of the two documents of each ``(window, i, j)``."""
    pairs = pairs.drop("cell")
    side = lambda c, v: embeddings.select(
        "model", "window", F.col("patent").alias(c), F.col("embedding").alias(v)
    )
    joined = fan_out(pairs, "window", "i").join(side("i", "_a"), ["window", "i"]).join(side("j", "_b"), ["model", "window", "j"])
    return joined.withColumn("similarity", dot(F.col("_a"), F.col("_b"))).select(
        "model", *pairs.columns, "similarity"
    )


def pair_cells(pairs: DataFrame) -> DataFrame:
    """``cell`` for pairs that have none: blocks of documents meet in cells of their own, whatever pairs there are."""
    if "cell" in pairs.columns:
        return pairs
    # only the size of a block depends on these numbers
    sizes = pairs.groupBy("window").agg(F.greatest(F.approx_count_distinct("i"), F.approx_count_distinct("j")).alias("_n"))
    sizes = sizes.select("window", F.ceil(F.col("_n") / CELL).cast("int").alias("_blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.greatest("_blocks", F.lit(1)))
    return pairs.join(F.broadcast(sizes), "window").withColumn("cell", F.xxhash64(block("i"), block("j"))).drop("_blocks")  # one row for each window


def pair_similarity_sparse(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """C-8 for long-form vectors; pairs without a common term get 0.

    Pairs lie in cells (``sample_pairs`` names them, so that a document is in one cell with almost all its partners). A document
    travels packed: once to learn its cells, and once to each cell that it is in. ``embeddings`` may hold arrays of (term, w),
    as ``v``.
    """
    columns = [c for c in pairs.columns if c != "cell"]
    pairs = cut_lineage(pair_cells(pairs))  # ids only, read for the places of both sides and for the pairs themselves
    if "v" not in embeddings.columns:
        entry = F.struct(F.col("term"), F.col("w").cast("double").alias("w"))
        embeddings = embeddings.groupBy("model", "window", "patent").agg(F.collect_list(entry).alias("v"))
    parts = 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("patent"), F.lit(parts)).cast("int").alias("part")
    long = F.col("patent").cast("long").alias("patent")
    vectors = embeddings.select("model", "window", long, "v").select("window", part, "model", "patent", "v")
    sent = vectors.mapInArrow(packer(["part"], "v"), "part int, package binary")
    side = lambda c: pairs.select("window", F.col(c).cast("long").alias("patent"), "cell")
    spots = side("i").union(side("j")).distinct().where("patent IS NOT NULL").select(part, F.lit(0).alias("kind"), "window", "patent", "cell")
    meet = spots.unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    meet = meet.repartition("part").sortWithinPartitions("part", "kind")
    placed = meet.mapInArrow(deal_to_cells, "window string, cell long, model string, package binary")

    pair = F.struct(*columns).alias("pair")
    rows = pairs.select("window", "cell", F.lit(0).alias("kind"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), pair)
    cells = rows.unionByName(placed.withColumn("kind", F.when(F.col("cell").isNull(), 2).otherwise(1)), allowMissingColumns=True)
    # the models of a window have no cell; they are a few rows, and pass
    cells = cells.repartition(parts // 2, "window", "cell").sortWithinPartitions("window", "cell", "kind")
    kind = cells.schema["pair"].dataType.simpleString()
    found = cut_lineage(cells.mapInArrow(cell_products, f"window string, pair {kind}, model string, models array<string>, similarity array<double>"))
    models = found.where("model IS NOT NULL").select("window", "model").distinct()
    found = found.where("model IS NULL").drop("model").join(F.broadcast(models), "window")  # as small as the run specification
    value = F.get("similarity", (F.array_position("models", F.col("model")) - 1).cast("int"))
    return found.select("model", *[F.col(f"pair.{c}").alias(c) for c in columns], F.coalesce(value, F.lit(0.0)).alias("similarity"))


class Spots:
    """The cells of the documents of a part."""

    def __init__(self, parts: list[pa.RecordBatch]):
        column = lambda c: pa.concat_arrays([p.column(c) for p in parts])
        named = pc.dictionary_encode(column("window"))
        window, patent, cell = (x.to_numpy(zero_copy_only=False) for x in (named.indices, column("patent"), column("cell")))
        order = np.lexsort((patent, window))
        self.windows, self.patent, self.cell = named.dictionary, patent[order], cell[order]
        self.bounds = np.searchsorted(window[order], np.arange(len(self.windows) + 1))

    def place(self, docs: Rows) -> Rows:
        """Each document once for each of its cells."""
        window = pc.index_in(docs.own.column("window"), value_set=self.windows).fill_null(-1).to_numpy(zero_copy_only=False)
        known = docs.own.column("patent").is_valid().to_numpy(zero_copy_only=False)
        patent = docs.own.column("patent").fill_null(0).to_numpy(zero_copy_only=False)
        rows, cells = [], []
        for w in np.unique(window[known & (window >= 0)]):
            own = np.flatnonzero(known & (window == w))
            at = self.patent[self.bounds[w] : self.bounds[w + 1]]
            first, last = (np.searchsorted(at, patent[own], side) for side in ("left", "right"))
            n = last - first
            rows.append(np.repeat(own, n))
            cells.append(self.cell[self.bounds[w] + np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        rows, cells = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (rows, cells))
        out = docs.take(rows)
        out.own = out.own.append_column("cell", pa.array(cells, pa.int64()))
        return out


def deal_to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packages of a part, after the cells of its documents, to packages by cell; a row without a cell names a model."""

    def full(rows: pa.RecordBatch, models: pa.Array, packages: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.select(["window", "cell"]).columns, models, packages], names=["window", "cell", "model", "package"])

    def sent(held: list[Rows]) -> Iterator[pa.RecordBatch]:
        for rows in send(held, ["window", "cell"]):
            yield full(rows, pa.nulls(len(rows), pa.string()), rows.column("package"))

    part, parts, spots, held, n, models = None, [], None, [], 0, set()
    for key, rows in runs(batches, ["part", "kind"]):
        if key[0] != part:
            part, parts, spots = key[0], [], None
        if key[1] == 0:
            parts.append(rows)
            continue
        spots = spots or (Spots(parts) if parts else None)
        for package in rows.column("package"):
            docs = Rows.unpack(package.as_py())
            models.update(zip(docs.own.column("window").to_pylist(), docs.own.column("model").to_pylist()))
            if spots is None:  # no document of the part is in a pair
                continue
            held.append(spots.place(docs))
            n += len(held[-1].codes)
            if n >= FULL:
                yield from sent(held)
                held, n = [], 0
    if n:
        yield from sent(held)
    if models:
        window, model = (pa.array(x, pa.string()) for x in zip(*sorted(models)))
        yield pa.RecordBatch.from_arrays(
            [window, pa.nulls(len(window), pa.int64()), model, pa.nulls(len(window), pa.binary())], names=["window", "cell", "model", "package"]
        )


def cell_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarities of the pairs of each cell, under all models that have documents there; models of windows pass."""

    def result(pairs: list[pa.RecordBatch], docs: list[Rows]) -> Iterator[pa.RecordBatch]:
        rows = Rows.concat(docs) if docs else None
        models, number = (sorted(set(rows.own.column("model").to_pylist())), rows.own.column("model")) if docs else ([], None)
        made = [PairProducts(rows, np.flatnonzero(pc.equal(number, m).to_numpy(zero_copy_only=False))) for m in models]
        for batch in pairs:
            ids = [batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in "ij"]
            known = (batch.column("i").is_valid().to_numpy(zero_copy_only=False)) & (batch.column("j").is_valid().to_numpy(zero_copy_only=False))
            values = np.array([m.of(*ids, known) for m in made]).reshape(len(models), len(batch))
            ends = pa.array(np.arange(len(batch) + 1) * len(models), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("window"), batch.column("pair"), pa.nulls(len(batch), pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(models * len(batch), pa.string())),
                    pa.ListArray.from_arrays(ends, pa.array(values.T.ravel())),
                ],
                names=["window", "pair", "model", "models", "similarity"],
            )

    current, pairs, docs = None, [], []
    for (window, cell, kind), rows in runs(batches, ["window", "cell", "kind"]):
        if kind == 2:
            n = len(rows)
            empty = [rows.column("pair"), rows.column("model"), *(pa.nulls(n, pa.list_(t)) for t in (pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([rows.column("window"), *empty], names=["window", "pair", "model", "models", "similarity"])
            continue
        if (window, cell) != current:
            yield from result(pairs, docs)
            current, pairs, docs = (window, cell), [], []
        if kind == 0:
            pairs.append(rows)
        else:
            docs += [Rows.unpack(p.as_py()) for p in rows.column("package")]
    yield from result(pairs, docs)


class PairProducts:
    """Dot products of documents by id: the first document is spread out over all terms, and its partners look theirs up.

    Products are added up exactly, so pairs of equal documents get equal values whatever their terms are.
    """

    def __init__(self, rows: Rows, own: np.ndarray):
        own = own[rows.lens[own] > 0]
        self.ids, doc = np.unique(rows.own.column("patent").to_numpy(zero_copy_only=False)[own], return_inverse=True)
        at = rows.entries(own[np.argsort(doc, kind="stable")])  # rows of one id are one document
        self.codes, self.w = rows.codes[at], rows.fields["w"][at]
        self.lens = np.bincount(doc, rows.lens[own], len(self.ids)).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.spread = np.zeros(len(rows.names))

    def of(self, i: np.ndarray, j: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        if not len(self.ids):
            return out
        places = [np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1) for x in (i, j)]
        pairs = np.flatnonzero(known & (self.ids[places[0]] == i) & (self.ids[places[1]] == j))
        pairs = pairs[np.argsort(places[0][pairs], kind="stable")]
        first, second = (x[pairs] for x in places)
        for run in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(first)) + 1):
            if not len(run):
                continue
            a = slice(self.starts[first[run[0]]], self.starts[first[run[0]]] + self.lens[first[run[0]]])
            np.add.at(self.spread, self.codes[a], self.w[a])
            lens, starts = self.lens[second[run]], self.starts[second[run]]
            begin = np.cumsum(lens) - lens
            at = np.repeat(starts - begin, lens) + np.arange(lens.sum())
            product = self.spread[self.codes[at]] * self.w[at]
            whole = np.floor(product * WHOLE)
            rest = np.floor((product * WHOLE - whole) * REST)
            sums = [np.add.reduceat(x.astype(np.int64), begin) for x in (whole, rest)]
            out[pairs[run]] = sums[0] / WHOLE + sums[1] / (WHOLE * REST)
            self.spread[self.codes[a]] = 0.0
        return out


def spearman(df: DataFrame, group: list[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """G-7: correlation of tie-averaged ranks per group; NULL when a side does not vary.

    Rows are folded into a contingency table, one row for each (x, y) of a group, which is written once. Only its margins are
    ranked, by distributed prefix sums over the distinct values, and its cells meet the ranks: what many rows share
    (0, typically) is one value, looked up once for each value of the other side and not once for each row.
    """
    cells = df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    cells = cut_lineage(cells.na.drop(subset=["_x", "_y"]).groupBy(*group, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")))
    ranked = cells
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        ranks = tie_averaged_ranks(cells, group, value, weight="_n")
        ranked = ranked.join(ranks.select(*group, value, F.col("rank").alias(rank)), [*group, value])
    n, a, b = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*group).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * b).alias("ab"),
        F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"),
        ((F.min(a) < F.max(a)) & (F.min(b) < F.max(b))).alias("varies"),
    )
    over = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("n")
    value = over("a", "b", "ab") / F.sqrt(over("a", "a", "aa") * over("b", "b", "bb"))
    return sums.select(*group, F.when(F.col("varies"), value).alias(out))


def model_grades(similarities: DataFrame) -> DataFrame:
    """G-8: ``(model, window, year, spearman)`` over all windows and models in one job.

    Raw values are ranked: similarities are exact sums, so ties are ties in every run.
    """
    grades = spearman(similarities, ["model", "window"], "similarity", "correlation")
    return grades.select("model", "window", plot_year(F.col("window")).alias("year"), "spearman")


def grades_cached(stored: DataFrame, similarities: DataFrame) -> DataFrame:
    """G-8 with its cache: only (model, window) pairs without a stored grade are computed."""
    new = similarities.join(stored, ["model", "window"], "left_anti")
    return stored.select("model", "window", plot_year(F.col("window")).alias("year"), "spearman").unionByName(
        model_grades(new)
    )


def check_models(models) -> list[str] | None:
    """B-8: None, one name, or a list of names."""
    if models is None or isinstance(models, list):
        return models
    if isinstance(models, str):
        return [models]
    raise TypeError(f"a model name or a list of names is needed, not {models!r}")


def filter_models(df: DataFrame, models=None, window: str | None = None) -> DataFrame:
    """B-8: rows of the wanted models and window."""
    wanted = check_models(models)
    if wanted is not None:
        df = df.where(F.col("model").isin(*wanted))
    return df if window is None else df.where(F.col("window") == window)


def mean_grade(grades: DataFrame) -> DataFrame:
    """G-9: mean over windows, the loss a tuning run minimises, and the number of windows without a grade.

    A window without pairs, or whose values are all equal, has no grade and no part in the mean.
    """
    return grades.groupBy("model").agg(
        F.avg("spearman").alias("mean_spearman"), F.count_if(F.col("spearman").isNull()).alias("ungraded")
    ).select("model", "mean_spearman", (-F.col("mean_spearman")).alias("loss"), "ungraded")


def window_difference(first: DataFrame, second: DataFrame, column: str = "novelty") -> DataFrame:
    """C-15: rank correlation per model of one score under two reaches, paired by document.

    Documents without a score under either reach are left out.
    """
    keys = ["model", "window", "patent"]
    pairs = paired_scores(first, second, column, keys)
    return spearman(pairs, ["model"], "first", "second")


def paired_scores(
    first: DataFrame, second: DataFrame, column: str, keys: list[str] = ("model", "window", "patent")
) -> DataFrame:
    keys = list(keys)
    a = first.where("exponent = 1").select(*keys, F.col(column).alias("first"))
    b = second.where("exponent = 1").select(*keys, F.col(column).alias("second"))
    return a.join(b, keys).na.drop()


def sample_points(pairs: DataFrame, show_max: int = 100, seed: int = 0) -> DataFrame:
    """P-3: at most ``show_max`` points per model for display."""
    from tidemark.functions.vectors import hash60

    keyed = pairs.withColumn("_key", F.shiftright(hash60(F.col("window"), F.col("patent"), seed=seed), 12))
    return first_n(keyed, ["model"], "_key", show_max).drop("_key")
