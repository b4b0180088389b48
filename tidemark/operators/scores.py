"""Novelty and impact of focal documents from embeddings.

For unit vectors the similarity of a focal vector u and a back or forward vector v is
s = (1 + u.v) / 2. The power mean over v with a small whole exponent expands into means of
(u.v)^k, which need only the moment sums of v: cost grows with the documents, not with the pairs, at any dimension.
Other exponents, and data too small for that to pay, multiply bounded blocks of vectors and keep the row sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.vectors import l2_normalise, smoothed_ratio, unit_similarity
from tidemark.operators import blocks as B
from tidemark.operators.skew import skew_join
from tidemark.operators.sparse import range_sums
from tidemark.operators.windows import focal_years, frames, window_positions
from tidemark.session import cut_lineage

SLAB = 1 << 19  # numbers in a row of moments, 4 MB; less where a task needs those of many years
SIMILARITIES = "patent long, exponent double, back double, forward double"


def power_mean(total: Column, n: Column, p: Column) -> Column:
    """G-2 from a sum of powers."""
    return F.pow(total / n, 1.0 / p)


def finish(similarities: DataFrame, keep: list[str]) -> DataFrame:
    """Novelty and impact from the two mean similarities (NULL when a side has no documents)."""
    return similarities.select(
        *keep,
        (1.0 - F.col("back")).alias("novelty"),
        smoothed_ratio(F.col("forward"), F.col("back")).alias("impact"),
    )


def as_exponents(exponents: float | list[float]) -> list[float]:
    """Q-11: one number, whole or not, stands for a list of one."""
    if isinstance(exponents, (int, float)):
        exponents = [exponents]
    return sorted({float(p) for p in exponents})


def moments_pay(gathered: DataFrame, frame: DataFrame, p: float, dim: int) -> bool:
    """Whether moment sums take less work than pairs of blocks. Both are exact.

    The sums of a year have one size, whatever the documents; once they are few beside the vectors (from about dim^2 / 24 documents
    in a year on for p = 3, dim / 8 for p = 2) the work in proportion to documents is the smaller one, and stays so as data grow.
    """
    if p not in (1.0, 2.0, 3.0):
        return False
    if p == 1.0:
        return True
    years = frame.select("year").distinct().count()
    held = gathered.agg(F.sum(F.size("ids"))).first()[0] or 0
    return years * sum(B.slab_size(dim, i, int(p)) for i in range(dim)) <= 8 * held * dim


def novelty_impact(
    embeddings: DataFrame,
    window_docs: DataFrame,
    exponents: float | list[float] = 1.0,
    reach: int | tuple[int, int] | None = None,
    dim: int | None = None,
    rows: int = B.ROWS,
    method: str | None = None,
) -> DataFrame:
    """G-3 for dense vectors: ``(model, window, exponent, focal_year, patent, novelty, impact)``.

    ``embeddings`` has ``model, patent, year, embedding``, and ``window`` when every window has its
    own vectors; without it, the vectors are shared by all windows and read once.
    ``method`` forces "moments" or "blocks" for all exponents.
    """
    exponents = as_exponents(exponents)
    frame = cut_lineage(frames(focal_years(window_docs, reach)))  # windows x sides x years, read by every step
    own = "window" in embeddings.columns
    keys = ["model", "window", "year"] if own else ["model", "year"]
    if dim is None:
        first = embeddings.select(F.size("embedding").alias("d")).first()
        dim = first["d"] if first else 1
    vectors = embeddings.select(*keys, "patent", l2_normalise(F.col("embedding")).alias("unit"))
    # blocks are read for moments, for focal documents and for pairs; the vectors behind them are read once
    gathered = cut_lineage(B.gather_dense(B.with_block(vectors, keys, rows), keys, "unit"))

    moment = [p for p in exponents if method == "moments" or (method is None and moments_pay(gathered, frame, p, dim))]
    paired = [p for p in exponents if p not in moment]
    on = ["window", "year"] if own else ["year"]
    parts = []
    if moment:
        parts.append(moment_similarities(gathered, frame, keys, on, moment, dim))
    if paired:
        parts.append(paired_similarities(gathered, frame, on, paired))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return finish(out, ["model", "window", "exponent", "focal_year", "patent"])


def moment_similarities(
    gathered: DataFrame, frame: DataFrame, keys: list[str], on: list[str], exponents: list[float], dim: int, slab: int = SLAB
) -> DataFrame:
    """Whole exponents from the sums of products of up to three components, at any dimension.

    The sums are rows by year and group of slabs. A part of the focal blocks meets those of all years, a group of slabs at a
    time: the rows of the years come first and are kept, then the blocks stream by, and each document's share of
    the sums of (u.v)^k leaves the task.
    """
    order = int(max(exponents))
    years = max(frame.select("year").distinct().count(), 1)
    groups = B.slab_groups(dim, order, max(min(slab, (SLAB << 4) // years), 1))
    total = sum(B.slab_size(dim, i, order) for i in range(dim))
    # as many blocks share a copy of the sums as have half their size
    parts = max(1, gathered.count() // max(32, years * total // (2 * B.ROWS * dim)))
    own = [k for k in keys if k != "year"]
    sides = frame.groupBy("window").agg(*[
        F.collect_set(F.when(F.col("side") == s, F.col("year"))).alias(s) for s in ("back", "forward")
    ])
    ranged = gathered.join(frame.where("side != 'focal'").select(*on).distinct(), on, "left_semi")
    sums = B.slab_moments(ranged, keys, groups, order)
    none = lambda t: F.lit(None).cast(t)
    sums = sums.select(
        *own, "slab", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "year",
        none("string").alias("of"), none("array<bigint>").alias("ids"), none("array<int>").alias("back"),
        none("array<int>").alias("forward"), F.col("vals").alias("flat"),
    )
    focal = gathered.join(frame.where("side = 'focal'").drop("side"), on).join(sides, "window")
    focal = focal.select(
        *own, F.explode(F.lit(list(range(len(groups))))).alias("slab"), F.pmod(F.xxhash64("year", "block"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"), "year", F.col("window").alias("of"), "ids", "back", "forward", "flat",
    )
    place = [*own, "slab", "part"]
    both = sums.unionByName(focal).repartition(*place).sortWithinPartitions(*place, "kind", "of")
    names = [f"{s}{k}" for s in "bf" for k in range(order + 1)]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, by_year, held_of, held = None, {}, None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, (kind, year, window, ids, back, forward, flat) = row[: len(place)], row[len(place) :]
                if key != current:
                    current, by_year, held_of = key, {}, None
                if kind == 0:
                    by_year[year] = np.array(flat)  # a copy: a view would keep its whole batch
                    continue
                group, u = groups[key[-2]], np.reshape(flat, (len(ids), -1))
                if window != held_of:  # blocks come by window: the sums of one are held at a time
                    held_of, held = window, {}
                    for side, wanted in (("back", back), ("forward", forward)):
                        known = [by_year[y] for y in sorted(wanted) if y in by_year]
                        held[side] = sum(known[1:], known[0]) if known else None
                columns = []
                for side in ("back", "forward"):
                    found = np.zeros((len(ids), order)) if held[side] is None else B.slab_powers(u, held[side], *group, order)
                    columns += [np.full(len(ids), 0.0 if held[side] is None else held[side][0]), *found.T]
                part = pd.DataFrame(dict(zip(names, columns)))
                part.insert(0, "patent", ids)
                part.insert(0, "focal_year", year)
                part.insert(0, "window", window)
                part.insert(0, "model", key[0])
                out.append(part)
            if out:
                yield pd.concat(out)

    schema = "model string, window string, focal_year int, patent long, " + ", ".join(f"{c} double" for c in names)
    shares = both.mapInPandas(kernel, schema)
    whole = shares.groupBy("model", "window", "focal_year", "patent").agg(
        *[(F.max if c.endswith("0") else F.sum)(c).alias(c) for c in names]
    )

    def mean_similarity(side: str, p: float) -> Column:
        k = int(p)
        n = F.nullif(F.col(f"{side}0"), F.lit(0.0))
        powers = sum((comb(k, j) * F.col(f"{side}{j}") / n for j in range(1, k + 1)), F.lit(1.0)) / 2.0**k
        return F.when(n.isNotNull(), F.pow(F.greatest(powers, F.lit(0.0)), F.lit(1.0 / p)))

    means = [
        F.struct(F.lit(p).alias("exponent"), mean_similarity("b", p).alias("back"), mean_similarity("f", p).alias("forward"))
        for p in exponents
    ]
    return whole.select("model", "window", "focal_year", "patent", F.inline(F.array(*means)))


def paired_similarities(gathered: DataFrame, frame: DataFrame, on: list[str], exponents: list[float]) -> DataFrame:
    """Any exponent: each focal block meets each back and forward block in a task of its own."""
    content = ["ids", "flat"]
    own = ["window"] if "window" in gathered.columns else []
    names = gathered.select("model", *own, "year", "block")
    focal = names.join(frame.where("side = 'focal'").drop("side"), on)
    targets = names.join(frame.where("side != 'focal'").drop("focal_year"), on)
    renamed = lambda df, p: df.select(
        "model", *own, F.col("year").alias(f"{p}_year"), F.col("block").alias(f"{p}_block"),
        *[F.col(c).alias(f"{p}_{c}") for c in content if c in df.columns],
    )
    # block names are paired first, so that no task copies the vectors of a whole window
    cells = focal.select(
        "model", "window", "focal_year", F.col("year").alias("f_year"), F.col("block").alias("f_block")
    ).join(
        targets.select(
            "model", "window", "side", F.col("year").alias("r_year"), F.col("block").alias("r_block")
        ),
        ["model", "window"],
    )
    cells = cells.join(renamed(gathered, "f"), ["model", *own, "f_year", "f_block"])
    cells = cells.join(renamed(gathered, "r"), ["model", *own, "r_year", "r_block"])
    fields = [f"f_{c}" for c in content] + [f"r_{c}" for c in content]
    cells = cells.select("model", "window", "focal_year", "side", *fields)
    powers = [f"s{k}" for k in range(len(exponents))]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(content)
        for batch in batches:
            for model, window, year, side, *data in batch.itertuples(index=False, name=None):
                a, b = tuple(data[:width]), tuple(data[width:])
                u, v = B.as_matrices(a, b, sparse=False)
                sums = B.power_sums((u @ v.T + 1.0) / 2.0, exponents)
                out = pd.DataFrame(sums, columns=powers)
                out.insert(0, "patent", a[0])
                yield out.assign(
                    model=model, window=window, focal_year=year, side=side, n=len(b[0])
                )

    schema = (
        "model string, window string, focal_year int, side string, patent long, n long, "
        + ", ".join(f"{c} double" for c in powers)
    )
    sums = cells.mapInPandas(kernel, schema)
    pair = F.array(
        *[
            F.struct(F.lit(p).alias("exponent"), F.col(c).alias("s"))
            for p, c in zip(exponents, powers)
        ]
    )
    long = sums.select(
        "model", "window", "focal_year", "side", "patent", "n", F.explode(pair).alias("e")
    )
    at = lambda side, c: F.sum(F.when(F.col("side") == side, c))
    summed = long.groupBy("model", "window", "focal_year", "patent", "e.exponent").agg(
        at("back", F.col("e.s")).alias("sb"), at("back", F.col("n")).alias("nb"),
        at("forward", F.col("e.s")).alias("sf"), at("forward", F.col("n")).alias("nf"),
    )
    p = F.col("exponent")
    scored = summed.select(
        "model", "window", "focal_year", "patent", "exponent",
        power_mean(F.col("sb"), F.col("nb"), p).alias("back"),
        power_mean(F.col("sf"), F.col("nf"), p).alias("forward"),
    )
    # focal documents of a window without any back or forward document keep a NULL score
    bare = focal.join(targets.select("model", "window").distinct(), ["model", "window"], "left_anti")
    bare = bare.join(gathered, ["model", *own, "year", "block"])
    empty = bare.select(
        "model", "window", "focal_year", F.explode("ids").alias("patent")
    ).withColumn("exponent", F.explode(F.array(*[F.lit(x) for x in exponents])))
    null = F.lit(None).cast("double")
    return scored.unionByName(empty.withColumn("back", null).withColumn("forward", null))


# --- sparse vectors ------------------------------------------------------------------------------


def unit_terms(embeddings: DataFrame) -> DataFrame:
    """Long-form vectors divided by their length; zero vectors have no rows."""
    docs = Window.partitionBy("model", "window", "patent")  # one document's terms
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(docs))
    return (
        embeddings.withColumn("_len", length)
        .where("_len > 0")
        .withColumn("w", F.col("w") / F.col("_len"))
        .drop("_len")
    )


def unit_docs(embeddings: DataFrame) -> DataFrame:
    """``(model, window, patent, terms, ws)``: unit vectors, one row per document; zero vectors have none.

    ``embeddings`` is in long form ``(term, w)``, or holds arrays of them as ``v``.
    """
    terms = F.flatten(F.collect_list("v")) if "v" in embeddings.columns else F.collect_list(F.struct("term", "w"))
    docs = embeddings.groupBy("model", "window", "patent").agg(terms.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"])
    docs = docs.withColumn("_len", F.sqrt(square)).where("_len > 0")
    # array_repeat evaluates the length once per row instead of once per term
    ws = F.zip_with(F.col("v.w"), F.array_repeat("_len", F.size("v")), lambda w, n: w / n)
    return docs.select("model", "window", "patent", F.col("v.term").alias("terms"), ws.alias("ws"))


def novelty_impact_sparse(
    embeddings: DataFrame,
    window_docs: DataFrame,
    exponents: float | list[float] = 1.0,
    reach: int | tuple[int, int] | None = None,
    rows: int | None = None,
    method: str | None = None,
) -> DataFrame:
    """G-3 for long-form vectors ``(model, window, patent, term, w)``, or rows of documents with arrays ``v`` of (term, w).

    ``window_docs(window, patent, year)`` supplies the documents without any term as well: their
    similarity to everything is 1/2. ``rows`` bounds the documents of a block, which is bounded in terms anyway.
    """
    exponents = as_exponents(exponents)
    frame = cut_lineage(frames(focal_years(window_docs, reach)))  # windows x sides x years, read by every step
    members = window_docs.join(frame, ["window", "year"])
    units = cut_lineage(unit_docs(embeddings))
    models = units.select("model", "window").distinct()
    parts = []
    first = [p for p in exponents if p == 1.0 and method != "blocks"]
    rest = [p for p in exponents if p not in first]
    if first:
        parts.append(sparse_means(units, members, models))
    if rest:
        none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
        docs = window_docs.join(models, "window").join(units, ["model", "window", "patent"], "left")
        docs = docs.select("model", "window", "patent", "year", none("terms", "string"), none("ws", "double"))
        parts.append(sparse_powers(docs, frame, rest, rows))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return finish(out, ["model", "window", "exponent", "focal_year", "patent"])


def sparse_powers(docs: DataFrame, frame: DataFrame, exponents: list[float], rows: int | None) -> DataFrame:
    """Any exponent: mean similarities from the sums of focal blocks over parts of their range."""
    mean = lambda s, k, p: power_mean(F.col(f"{s}{k}"), F.nullif(F.col(f"n{s}"), F.lit(0)), F.lit(p))
    means = [
        F.struct(F.lit(p).alias("exponent"), mean("b", k, p).alias("back"), mean("f", k, p).alias("forward"))
        for k, p in enumerate(exponents)
    ]
    sums = range_sums(cut_lineage(docs), frame, exponents, rows)  # read for the sizes of windows and for the sums
    return sums.select("model", "window", "focal_year", "patent", F.inline(F.array(*means)))


def sparse_means(units: DataFrame, members: DataFrame, models: DataFrame) -> DataFrame:
    """Mean similarity by term sums: one aggregate over the range, one lookup per focal term."""
    placed = units.join(members, ["window", "patent"])
    placed = placed.select(
        "model", "window", "patent", "side", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ws").alias("w")))
    )
    ranges = placed.where("side != 'focal'")
    at = lambda side: F.sum(F.when(F.col("side") == side, F.col("w")))
    sums = ranges.groupBy("model", "window", "term").agg(
        at("back").alias("wb"), at("forward").alias("wf")
    )
    focal = placed.where("side = 'focal'")
    most = members.where("side = 'focal'").groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    largest = most.agg(F.max("n")).first()[0] or 0  # no term has more focal rows in a window
    dots = (
        skew_join(focal, sums, ["model", "window", "term"], "left", most=largest)
        .groupBy("model", "window", "patent")
        .agg(
            F.sum(F.col("w") * F.coalesce("wb", F.lit(0.0))).alias("db"),
            F.sum(F.col("w") * F.coalesce("wf", F.lit(0.0))).alias("df"),
        )
    )
    count = lambda side: F.count_if(F.col("side") == side)
    sizes = members.groupBy("window").agg(count("back").alias("nb"), count("forward").alias("nf"))
    docs = members.where("side = 'focal'").select("window", "focal_year", "patent")
    rows = docs.join(models, "window").join(sizes, "window").join(
        dots, ["model", "window", "patent"], "left"
    )
    mean = lambda d, n: unit_similarity(
        F.coalesce(F.col(d), F.lit(0.0)) / F.nullif(F.col(n), F.lit(0))
    )
    return rows.select(
        "model", "window", "focal_year", "patent", F.lit(1.0).alias("exponent"),
        mean("db", "nb").alias("back"), mean("df", "nf").alias("forward"),
    )


# --- cached scores, wide form, autocorrelation ---------------------------------------------------


def missing_scores(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """G-4: the (window, model) pairs of which at least one requested exponent is not stored."""
    have = stored.select("model", "window", "exponent").distinct()
    return requested.join(have, ["model", "window", "exponent"], "left_anti").select(
        "model", "window"
    ).distinct()


def scores_cached(requested: DataFrame, stored: DataFrame, compute) -> DataFrame:
    """G-4: stored scores where all exponents exist, freshly computed ones elsewhere.

    ``compute`` maps the missing ``(model, window)`` pairs to a score table.
    """
    missing = missing_scores(requested, stored)
    kept = stored.join(requested, ["model", "window", "exponent"], "left_semi").join(
        missing, ["model", "window"], "left_anti"
    )
    return kept.unionByName(compute(missing))


def scores_wide(scores: DataFrame, exponents: list[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """J-7: one row per model and document, one column pair per exponent."""
    at = lambda p, c: F.max(F.when(F.col("exponent") == p, F.col(c)))
    return scores.groupBy("model", F.col("patent").alias("patent_ids"), "window").agg(
        *[
            at(p, c).alias(f"{c}-{p}")
            for p in exponents
            for c in ("impact", "novelty")
        ]
    ).drop("window")


# The distances of the autocorrelation are int(LAG_START + LAG_RATE * k^2) for k < LAGS.
LAG_START, LAG_RATE, LAGS = 1.5, 0.3, 5000
LAG_BLOCK = 1 << 20  # numbers in a block of vectors, 8 MB


def lags() -> np.ndarray:
    k = np.arange(LAGS, dtype=float)
    return np.unique(np.floor(LAG_START + LAG_RATE * k * k).astype(np.int64))


def autocorrelation(
    embeddings: DataFrame, window_docs: DataFrame, years_per_window: float = 4.0,
    rows: int | None = None, sparse: bool = False,
) -> DataFrame:
    """G-10: mean dot product of unit vectors ``delta`` positions apart.

    Positions are cut into blocks; a pair of blocks adds up all distances that fall between them. Blocks of dense vectors hold
    about LAG_BLOCK numbers unless ``rows`` is given: the larger a block, the fewer others its copies meet.
    Dense ``embeddings`` carry ``model, window, patent, embedding``, sparse ones ``term, w``.
    """
    spark = embeddings.sparkSession
    if rows is None:
        first = None if sparse else embeddings.select(F.size("embedding").alias("d")).first()
        rows = max(LAG_BLOCK // max(first["d"], 1), 1) if first else B.ROWS
    positions = window_positions(window_docs).select("window", "patent", "pos")
    sizes = window_docs.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    keys = ["model", "window"]
    if sparse:
        units = unit_terms(embeddings.select("model", "window", "patent", "term", "w"))
        docs = units.groupBy("model", "window", "patent").agg(
            F.collect_list(F.struct("term", "w")).alias("tw")
        )
        placed = (
            positions.join(embeddings.select("model", "window").distinct(), "window")
            .join(docs, ["model", "window", "patent"], "left")
            .select(
                "model", "window", "patent", "pos",
                F.coalesce("tw.term", F.array().cast("array<string>")).alias("terms"),
                F.coalesce("tw.w", F.array().cast("array<double>")).alias("ws"),
            )
        )
    else:
        units = embeddings.select(
            "model", "window", "patent", l2_normalise(F.col("embedding")).alias("unit")
        )
        placed = units.join(positions, ["window", "patent"])
    placed = placed.withColumn("block", F.expr(f"pos div {rows}"))
    gathered = cut_lineage(
        B.gather_sparse(placed, keys, "pos") if sparse else B.gather_dense(placed, keys, "unit", "pos")
    )
    content = ["ids", "lens", "terms", "flat"] if sparse else ["ids", "flat"]
    # names of blocks are paired at the distances that occur, then the blocks are joined to the pairs
    apart = sorted({int(q) for d in lags() for q in (d // rows, d // rows + 1)})
    steps = spark.createDataFrame([(q,) for q in apart], "q long")  # at most twice the lags
    names = gathered.select(*keys, F.col("block").alias("a")).join(sizes, "window")
    names = names.join(F.broadcast(steps), F.expr(f"a + q <= (n - 1) div {rows}"))
    pairs = names.select(*keys, "n", "a", (F.col("a") + F.col("q")).alias("b"))
    side = lambda p: gathered.select(
        *keys, F.col("block").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in content]
    )
    cells = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).select(
        *keys, "n", "a", "b", *[f"a_{c}" for c in content], *[f"b_{c}" for c in content]
    )

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_deltas = lags()
        width = len(content)
        for batch in batches:
            for model, window, n, a, b, *data in batch.itertuples(index=False, name=None):
                u, v = B.as_matrices(tuple(data[:width]), tuple(data[width:]), sparse)
                a0, b0 = a * rows, b * rows
                found = []
                near = all_deltas[
                    (all_deltas < n)
                    & (all_deltas > b0 - a0 - len(u))
                    & (all_deltas < b0 - a0 + len(v))
                ]
                for delta in near:
                    low, high = max(a0, b0 - delta), min(a0 + len(u), b0 + len(v) - delta)
                    if high > low:
                        x = u[low - a0 : high - a0]
                        y = v[low + delta - b0 : high + delta - b0]
                        found.append((model, window, n, delta, float(np.einsum("ij,ij->", x, y))))
                if found:
                    yield pd.DataFrame(found, columns=["model", "window", "n", "delta", "s"])

    sums = cells.mapInPandas(kernel, "model string, window string, n long, delta long, s double")
    return sums.groupBy("model", "window", "n", "delta").agg(F.sum("s").alias("s")).select(
        "model", "window", "delta",
        (years_per_window * F.col("delta") / F.col("n")).alias("delta_year"),
        (F.col("s") / (F.col("n") - F.col("delta"))).alias("autocorrelation"),
    )
