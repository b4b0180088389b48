"""Documents and their hierarchical classification codes: similarity, pairs, novelty and impact."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.codes import (
    BASE,
    LEVELS,
    code_similarity,
    int_levels,
    level_similarity,
    prefixes,
    text_levels,
)
from tidemark.functions.vectors import hash60, smoothed_ratio
from tidemark.operators.blocks import ROWS, with_block
from tidemark.operators.ranking import with_position
from tidemark.operators.scores import as_exponents, power_mean
from tidemark.operators.skew import skew_join
from tidemark.session import cut_lineage, fan_out


def codes_with_year(codes: DataFrame, years: DataFrame) -> DataFrame:
    """C-2, B-5: every code row with the year of its document; rows without a year are dropped."""
    return codes.join(years, "pat").na.drop().withColumn("year", F.col("year").cast("int"))


def code_vectors(codes: DataFrame, years: DataFrame) -> DataFrame:
    """C-16: ``(pat, year, progr, levels)`` with six integer levels; malformed codes are dropped."""
    dated = codes_with_year(codes, years).withColumn("levels", int_levels(F.col("CPC")))
    return dated.where("levels IS NOT NULL").select("pat", "year", "progr", "levels")


def sorted_codes(codes: DataFrame, years: DataFrame) -> DataFrame:
    """T-2: code rows with a year, by year, id and running number."""
    return codes_with_year(codes, years).orderBy("year", "pat", "progr")


def malformed_codes(codes: DataFrame) -> DataFrame:
    """Q-5: how many code rows the level pattern rejects."""
    return codes.agg(F.count_if(int_levels(F.col("CPC")).isNull()).alias("malformed"))


def codes_for_docs(codes: DataFrame, docs: DataFrame) -> DataFrame:
    """C-3: code rows of the given documents."""
    wanted = docs.select(F.col("patent").alias("pat"))
    return codes.join(wanted, "pat", "left_semi")


def codes_per_doc(codes: DataFrame) -> DataFrame:
    """G-1: the list of codes of each document, in ``progr`` order."""
    rows = F.sort_array(F.collect_list(F.struct("progr", "CPC")))
    return codes.groupBy("pat").agg(rows.alias("rows")).select("pat", F.col("rows.CPC").alias("CPC"))


def counted_codes(codes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Each document's distinct codes with their counts: as long as its vocabulary, not its rows."""
    counted = codes.groupBy("pat", *keep, "CPC").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(text_levels(F.col("CPC")).alias("levels"), F.col("n").alias("n"))
    return counted.groupBy("pat", *keep).agg(F.sort_array(F.collect_list(entry)).alias("codes"))


def list_similarity(a: Column, b: Column, base: float = BASE) -> Column:
    """G-5 for two counted code lists: mean of the best match of every code row on either side."""
    best = lambda xs, ys: F.aggregate(
        xs,
        F.lit(0.0),
        lambda acc, x: acc
        + x["n"] * F.array_max(F.transform(ys, lambda y: code_similarity(x["levels"], y["levels"], base))),
    )
    rows = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return (best(a, b) + best(b, a)) / (rows(a) + rows(b))


def pair_code_similarity(pairs: DataFrame, codes: DataFrame, base: float = BASE) -> DataFrame:
    """G-5, C-10: add ``correlation`` to pairs ``(i, j)``; equal ids give 1, unknown ids NULL."""
    lists = counted_codes(codes)
    left = lists.select(F.col("pat").alias("i"), F.col("codes").alias("_a"))
    right = lists.select(F.col("pat").alias("j"), F.col("codes").alias("_b"))
    value = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        list_similarity(F.col("_a"), F.col("_b"), base)
    )
    # dealt by i, so the first lists join where the pairs are
    joined = fan_out(pairs, "i").join(left, "i", "left").join(right, "j", "left")
    return joined.withColumn("correlation", value).drop("_a", "_b").select(
        *pairs.columns, "correlation"
    )


def require_known(pairs: DataFrame) -> DataFrame:
    """Turn a NULL similarity (a document without codes) into an error."""
    message = F.concat(F.lit("no codes for one of the documents "), F.concat_ws(", ", "i", "j"))
    return pairs.withColumn(
        "correlation", F.coalesce("correlation", F.raise_error(message).cast("double"))
    )


# --- pairs of documents --------------------------------------------------------------------------


def sample_pairs(
    docs: DataFrame, group: list[str], k: int, seed: Column | int = 0, min_docs: int | None = None, cells: bool = False
) -> DataFrame:
    """P-2, C-9: ``k`` distinct partners of every document of a group, as pairs ``(i, j)``.

    Documents take positions 0..n-1; partners sit at ``k`` circular offsets, equally spaced from a
    hashed start, so a document never meets itself or a partner twice, and the job is an equi-join
    of n*k rows. A group of at most k+1 documents gives all its pairs i < j instead.
    ``min_docs`` makes a smaller group an error. ``docs`` lists a document once per group.

    ``cells`` adds a number ``cell``: partners sit at nearly the same place modulo the distance of the offsets, so almost all
    pairs of a document share a cell, and a cell has about CELL documents on either side.
    """
    # ids and positions only; read for the group sizes and for both sides of the pairs
    placed = cut_lineage(with_position(docs.select(*group, "patent"), group, "patent"))
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    if min_docs is not None:
        message = F.format_string("need %d documents with codes to sample pairs", F.lit(min_docs))
        sizes = sizes.withColumn(
            "n", F.when(F.col("n") < min_docs, F.raise_error(message).cast("long")).otherwise(F.col("n"))
        )
    seed = F.lit(seed) if isinstance(seed, int) else seed
    others = F.nullif(F.col("n") - 1, F.lit(0))
    text = F.concat_ws("-", F.col("patent").cast("string"), seed.cast("string"))
    start = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    rows = placed.join(sizes, group).withColumn("start", F.pmod(start, others))
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    step = F.greatest(F.expr(f"(n - 1) div {k}"), F.lit(1))
    all_pairs = F.col("n") - 1 <= k
    offset = F.when(all_pairs, F.col("m") + 1).otherwise(
        F.pmod(F.col("start") + F.col("m") * step, others) + 1
    )
    rows = rows.where(~all_pairs | (F.col("m") + 1 <= F.col("n") - 1))
    rows = rows.withColumn("_to", F.pmod(F.col("pos") + offset, F.col("n")))
    cell = F.xxhash64(*group, F.floor(F.pmod(F.col("_to"), step) / max(CELL // k, 1)))
    # which pairs of a small group count is known before they travel
    more = [cell.alias("cell")] if cells else []
    left = rows.where(~all_pairs | (F.col("pos") < F.col("_to"))).select(*group, F.col("patent").alias("i"), F.col("_to").alias("to"), *more)
    right = placed.select(*group, F.col("patent").alias("j"), F.col("pos").alias("to"))
    return left.join(right, [*group, "to"]).select(*group, "i", "j", *[c for c in ("cell",) if cells])


CELL = 4096  # fixed value: documents on one side of a cell of pairs


def window_pairs(
    window_docs: DataFrame, codes: DataFrame, k: int = 10, base: float = BASE, cells: bool = False
) -> DataFrame:
    """P-2b: sampled pairs of each window with their code similarity; seed = mean year of the window."""
    known = codes.select(F.col("pat").alias("patent")).distinct()
    docs = window_docs.join(known, "patent", "left_semi")
    ends = F.split("window", "-")
    seed = F.bround((F.get(ends, 0).cast("int") + F.get(ends, 1).cast("int")) / 2.0).cast("int")
    pairs = sample_pairs(docs, ["window"], k, seed, cells=cells)
    return pair_code_similarity(pairs, codes, base)


def year_pairs(docs: DataFrame, codes: DataFrame, k: int = 10, seed: int = 12345, cells: bool = False) -> DataFrame:
    """J-1: pairs that never cross years, with their code similarity."""
    known = codes.select(F.col("pat").alias("patent")).distinct()
    pairs = sample_pairs(docs.join(known, "patent", "left_semi"), ["year"], k, seed, cells=cells)
    return pair_code_similarity(pairs, codes)


# --- novelty and impact from codes ---------------------------------------------------------------

STRIPE = 32  # lists that a block of focal lists meets at a time
CODE_ROWS = 4  # code rows of a block for each document that its size in documents stands for


def level_gains() -> list[float]:
    """What each further level of agreement adds to the similarity."""
    values = [level_similarity(k) for k in range(LEVELS + 1)]
    return [b - a for a, b in zip(values, values[1:])]


def code_frames(windows: DataFrame, back_years: int | None = None) -> DataFrame:
    """Focal year of each window range, and the first back year (None: all earlier years)."""
    focal = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    first = F.lit(-(1 << 31)).cast("int") if back_years is None else (F.col("focal_year") - back_years)
    return windows.withColumn("focal_year", focal).select(
        "window", "focal_year", "end", first.cast("int").alias("earliest")
    )


def code_novelty_impact(
    vectors: DataFrame,
    windows: DataFrame,
    exponents: float | list[float] = 1.0,
    back_years: int | None = None,
    rows: int = ROWS,
    method: str | None = None,
) -> DataFrame:
    """G-6: ``(window, exponent, focal_year, patent, back_similarity, novelty, impact)``.

    ``vectors`` is the table of ``code_vectors``. The similarity of a focal code to a document adds
    up one gain per prefix the document shares with it, so for a whole exponent p the power mean is
    a sum over sets of at most p prefixes, weighted by how many documents hold the whole set.
    Those counts grow with the documents; no pair of documents is formed. Other exponents compare
    bounded blocks of code lists. Documents of a year with the same codes are one list, with their number.
    """
    exponents = as_exponents(exponents)
    frame = code_frames(windows, back_years)
    counted = [p for p in exponents if p in (1.0, 2.0, 3.0) and method != "blocks"]
    paired = [p for p in exponents if p not in counted]
    lists, held = equal_lists(vectors)
    sizes = frame_sizes(lists, frame)
    parts = []
    if counted:
        rows_of = lists.select(F.col("list").alias("pat"), "year", "n", F.explode("codes").alias("levels"))
        parts.append(prefix_similarities(rows_of, frame, counted, sizes))
    if paired:
        parts.append(block_similarities(lists, frame, paired, rows, sizes))
    out = reduce(DataFrame.unionByName, parts).withColumnRenamed("patent", "list")
    out = skew_join(held, out, ["list"], counts=lists.select("list", "n"))
    return out.select(
        "window", "exponent", "focal_year", "patent",
        F.col("back").alias("back_similarity"),
        (1.0 - F.col("back")).alias("novelty"),
        smoothed_ratio(F.col("forward"), F.col("back")).alias("impact"),
    )


def equal_lists(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(list, year, codes, n)``: the distinct code lists of each year in any order of their codes, and ``(list, patent)``."""
    docs = vectors.groupBy("pat", "year").agg(F.array_sort(F.collect_list("levels")).alias("codes"))
    docs = cut_lineage(docs.withColumnRenamed("pat", "patent"))  # read for the lists and for their documents
    lists = docs.groupBy("year", "codes").agg(F.count(F.lit(1)).alias("n"))
    lists = cut_lineage(lists.withColumn("list", F.monotonically_increasing_id()))
    named = lists.select("year", "codes", "list")
    held = skew_join(docs, named, ["year", "codes"], counts=lists.select("year", "codes", "n")).select("list", "patent")
    return lists, held


def year_counts(lists: DataFrame) -> Column:
    """Documents with codes per year, as one array of (year, n): a scalar as long as the calendar."""
    per_year = lists.groupBy("year").agg(F.sum("n").alias("n"))
    return per_year.agg(F.collect_list(F.struct("year", "n"))).scalar()


def is_back(year: Column) -> Column:
    return (year < F.col("focal_year")) & (year >= F.col("earliest"))


def is_forward(year: Column) -> Column:
    return (year > F.col("focal_year")) & (year <= F.col("end"))


def frame_sizes(lists: DataFrame, frame: DataFrame) -> DataFrame:
    """Documents with codes in the back and forward range of each window (NULL for none)."""
    total = lambda test: F.aggregate(
        F.filter("_years", lambda e: test(e["year"])),
        F.lit(0).cast("long"),
        lambda acc, e: acc + e["n"],
    )
    return frame.withColumn("_years", year_counts(lists)).select(
        "window",
        F.nullif(total(is_back), F.lit(0)).alias("nb"),
        F.nullif(total(is_forward), F.lit(0)).alias("nf"),
    )


def add_prefix(key: Column, p: Column) -> Column:
    """The prefix set ``key`` and ``p``: ancestors of a member add nothing and are left out."""
    return F.when(F.exists(key, lambda e: e.startswith(p)), key).otherwise(
        F.sort_array(F.array_append(F.filter(key, lambda e: ~p.startswith(e)), p))
    )


def weighted_prefixes(vectors: DataFrame) -> DataFrame:
    """``(pat, year, n, held)``: each document's prefixes, weighted by its mean gain per code row; n is 1 unless a list stands for more."""
    gains = F.array(*[F.lit(g) for g in level_gains()])
    level = F.posexplode(prefixes(F.col("levels"))).alias("level", "prefix")
    n = F.col("n") if "n" in vectors.columns else F.lit(1).cast("long").alias("n")
    weights = vectors.select("pat", "year", n, level).groupBy("pat", "year", "n", "prefix").agg(
        F.sum(F.get(gains, F.col("level"))).alias("w"), F.count_if(F.col("level") == 0).alias("rows")
    )
    docs = weights.groupBy("pat", "year", "n").agg(
        F.sort_array(F.collect_list(F.struct("prefix", "w"))).alias("held"), F.sum("rows").alias("m")
    )
    mean = lambda e: F.struct(e["prefix"].alias("prefix"), (e["w"] / F.col("m")).alias("w"))
    return docs.select("pat", "year", "n", F.transform("held", mean).alias("held"))


def related(x: Column, y: Column) -> Column:
    """Whether one prefix is an ancestor of the other."""
    return x.startswith(y) | y.startswith(x)


def count_prefix_sets(docs: DataFrame, order: int) -> list[DataFrame]:
    """Documents per year of every set of up to ``order`` prefixes, none an ancestor of another: a table (key, years) per size.

    Grown like frequent sets: a set is only built from two sets that differ in their last member and are both held in more
    than one year. Others cannot be in a focal document and in its back or forward range, and neither can what contains them.
    """
    rows = docs.select("pat", "year", "n", F.lit("").alias("stem"), F.explode("held.prefix").alias("last"))
    tables = []
    for size in range(1, order + 1):
        rows = rows.select("pat", "year", "n", "stem", "last", F.concat("stem", "last").alias("key"))
        counts = rows.groupBy("key", "year").agg(F.sum("n").alias("n"))
        counts = counts.groupBy("key").agg(F.collect_list(F.struct("year", "n")).alias("years")).where(F.size("years") > 1)
        if order > 1:
            counts = cut_lineage(counts)  # read for the growth of both sides and for the totals
        tables.append(counts)
        if size < order:
            alive = rows.join(counts.select("key"), "key", "left_semi")
            alive = alive.groupBy("pat", "year", "n", "stem").agg(F.sort_array(F.collect_list("last")).alias("all"))
            alive = alive.select("pat", "year", "n", "stem", "all", F.posexplode("all").alias("at", "e"))
            further = F.slice("all", F.col("at") + 2, F.size("all"))
            rows = alive.select("pat", "year", "n", "stem", "e", F.explode(further).alias("last")).where(~related(F.col("e"), F.col("last")))
            rows = rows.select("pat", "year", "n", F.concat("stem", "e", F.lit(";")).alias("stem"), "last")
    return tables


def prefix_similarities(vectors: DataFrame, frame: DataFrame, exponents: list[float], sizes: DataFrame) -> DataFrame:
    docs = weighted_prefixes(vectors)
    order = int(max(exponents))
    if order > 1:
        docs = cut_lineage(docs)
    counts = count_prefix_sets(docs, order)
    key_text = F.array_join("key", ";").alias("key")

    # focal side: the p-th power of a document's weighted prefixes, multiplied out set by set
    focal_frame = frame.select("window", F.col("focal_year").alias("year"), "end", "earliest")
    base = ["window", "year", "end", "earliest", "pat"]
    mine = docs.join(focal_frame, "year").select(*base, "held")
    terms = mine.select(*base, F.posexplode("held").alias("at", "e"))
    terms = terms.select(*base, "at", F.lit(1).alias("run"), F.array("e.prefix").alias("key"), F.col("e.w").alias("w"))
    expanded = []
    for p in range(1, order + 1):
        if p > 1:
            # only terms whose set is also held in another year go on, since all that grows from the others is 0
            known = reduce(DataFrame.unionByName, [c.select(F.col("key").alias("_key")) for c in counts[: p - 1]])
            alive = terms.join(known, F.array_join("key", ";") == F.col("_key"), "left_semi")
            alive = alive.groupBy(*base).agg(F.collect_list(F.struct("at", "run", "key", "w")).alias("_terms"))
            terms = alive.join(mine, base).select(*base, "held", F.explode("_terms").alias("t")).select(*base, "held", "t.*")
            # prefixes are taken in order; p / run builds up the multinomial coefficient
            rest = F.slice("held", F.col("at") + 1, F.size("held"))
            run = F.when(F.col("step") == 0, F.col("run") + 1).otherwise(1)
            terms = terms.select(*base, "at", "run", "key", "w", F.posexplode(rest).alias("step", "e"))
            terms = terms.select(
                *base, (F.col("at") + F.col("step")).alias("at"), run.alias("run"),
                add_prefix(F.col("key"), F.col("e.prefix")).alias("key"),
                (F.col("w") * F.col("e.w") * (float(p) / run)).alias("w"),
            )
            if p < order:
                terms = cut_lineage(terms)  # read for its scores and for the terms that grow from it
        if float(p) in exponents:
            expanded.append(terms.select(*base, key_text, "w", F.lit(float(p)).alias("exponent")))
    # read three times: for the sets that are needed, for hot sets, and for the scores
    focal = cut_lineage(
        reduce(DataFrame.unionByName, expanded)
        .groupBy(*base, "key", "exponent")
        .agg(F.sum("w").alias("w"))
    )

    # one row per needed (set, window), at most one addition per year
    needed = focal.groupBy("key", "window").agg(
        F.count(F.lit(1)).alias("n"), F.first("year").alias("focal_year"),
        F.first("end").alias("end"), F.first("earliest").alias("earliest"),
    )
    per_year = reduce(DataFrame.unionByName, counts).select("key", F.explode("years").alias("e")).select("key", "e.year", "e.n")
    y = F.col("year")
    totals = (
        needed.drop("n")
        .join(per_year, "key")
        .groupBy("key", "window")
        .agg(
            F.sum(F.when(is_back(y), F.col("n"))).alias("cb"),
            F.sum(F.when(is_forward(y), F.col("n"))).alias("cf"),
        )
    )
    scored = skew_join(
        focal, totals, ["key", "window"], "left", spread="pat", counts=needed.select("key", "window", "n")
    ).select("window", "exponent", "year", "pat", "w", "cb", "cf")
    # a document whose sets are all its own scores 0
    none = [F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("cb"), F.lit(0).cast("long").alias("cf")]
    each = F.explode(F.array(*[F.lit(p) for p in exponents])).alias("exponent")
    scored = scored.unionByName(mine.select("window", each, "year", "pat", *none))
    add = lambda c: F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0)))
    sums = scored.groupBy("window", "exponent", F.col("year").alias("focal_year"), F.col("pat").alias("patent")).agg(
        add("cb").alias("sb"), add("cf").alias("sf")
    )
    p = F.col("exponent")
    return sums.join(sizes, "window", "left").select(
        "window", "exponent", "focal_year", "patent",
        power_mean(F.col("sb"), F.col("nb"), p).alias("back"),
        power_mean(F.col("sf"), F.col("nf"), p).alias("forward"),
    )


def block_sums(focal: tuple, other: tuple, exponents: list[float]) -> np.ndarray:
    """Sums over ``other`` of the similarity to each list of ``focal``, raised to each exponent: one column per exponent.

    ``focal`` is (lens, levels), ``other`` (lens, levels, n). Codes are compared once for each distinct code of either side;
    a list then takes the best rows of its codes, so a pair of lists costs an addition for each focal code and a power.
    """
    lens_f, codes_f, (of_f, starts_f, first_f) = *focal[:2], by_length(focal[0])
    lens_r, codes_r, (of_r, starts_r, first_r) = *other[:2], by_length(other[0])
    depth, in_a, in_b = shared_levels(codes_f, codes_r)
    best = depth[in_b[starts_r]]
    for k, n in enumerate(first_r[1:], 1):
        np.maximum(best[:n], depth[in_b[starts_r[:n] + k]], out=best[:n])
    table = np.array([level_similarity(k) for k in range(LEVELS + 1)])
    weights, n_codes = other[2][of_r].astype(float), lens_f[of_f][:, None]
    out = np.zeros((len(lens_f), len(exponents)))
    for at in range(0, len(best), STRIPE):  # few columns at a time stay in the processor's cache
        similar = table[np.ascontiguousarray(best[at : at + STRIPE].T)]
        total = similar[in_a[starts_f]]
        for k, n in enumerate(first_f[1:], 1):
            total[:n] += similar[in_a[starts_f[:n] + k]]
        total /= n_codes
        for k, p in enumerate(exponents):
            whole = p // 1
            # a root and a product are several times as fast as a power
            powers = total**whole * np.sqrt(total) if p == whole + 0.5 else total**p
            out[of_f, k] += powers @ weights[at : at + STRIPE]
    return out


def shared_levels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many levels each distinct code of ``b`` shares with each one of ``a``, and the places of all codes therein.

    Codes are sorted, so those with a common prefix are neighbours: each prefix that both sides have fills one rectangle.
    """
    both = np.concatenate([a, b])
    order = np.lexsort(both.T[::-1])
    sorted_codes = both[order]
    changes = np.logical_or.accumulate(sorted_codes[1:] != sorted_codes[:-1], axis=1)
    groups = np.concatenate([np.zeros((1, LEVELS), dtype=np.int64), np.cumsum(changes, axis=0)])
    code = np.empty(len(both), dtype=np.int64)
    code[order] = groups[:, -1]
    prefix = groups[np.unique(groups[:, -1], return_index=True)[1]]
    own_a, in_a = np.unique(code[: len(a)], return_inverse=True)
    own_b, in_b = np.unique(code[len(a) :], return_inverse=True)
    depth = np.zeros((len(own_b), len(own_a)), dtype=np.int8)
    for level in range(LEVELS):
        in_both = [np.unique(prefix[own, level], return_index=True, return_counts=True) for own in (own_a, own_b)]
        (ids_a, first_a, n_a), (ids_b, first_b, n_b) = in_both
        _, at_a, at_b = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
        for i, j in zip(at_a, at_b):
            depth[first_b[j] : first_b[j] + n_b[j], first_a[i] : first_a[i] + n_a[i]] = level + 1
    return depth, in_a, in_b


def by_length(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lists from the longest to the shortest, where each starts, and how many have more than 0, 1, 2, ... codes."""
    order = np.argsort(-lens, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)[order]
    return order, starts, [int((lens > k).sum()) for k in range(int(lens.max()))]


def block_similarities(
    lists: DataFrame, frame: DataFrame, exponents: list[float], rows: int, sizes: DataFrame
) -> DataFrame:
    """Any exponent: focal blocks against back and forward blocks, summed inside the task."""
    docs = lists.select(F.col("list").alias("patent"), "year", "n", F.flatten("codes").alias("levels"))
    # blocks are bounded in code rows, however long the lists are
    code_rows = F.size("levels") / LEVELS
    packed = with_block(docs, ["year"], CODE_ROWS * rows, size=code_rows).groupBy("year", "block").agg(
        F.collect_list(F.struct("patent", "n", "levels")).alias("r")
    )
    packed = cut_lineage(packed.select(
        "year", "block", F.col("r.patent").alias("ids"), F.col("r.n").alias("n"),
        F.transform("r.levels", lambda x: (F.size(x) / LEVELS).cast("int")).alias("lens"),
        F.flatten("r.levels").alias("flat"),
    ))  # read for the names of blocks and for both sides of the pairs
    names = packed.select("year", "block")
    focal = names.join(frame, F.col("year") == F.col("focal_year")).select(
        "window", "focal_year", F.col("block").alias("f_block")
    )
    other = names.select(F.col("year").alias("r_year"), F.col("block").alias("r_block"))
    in_range = F.filter("_years", lambda e: is_back(e["year"]) | is_forward(e["year"]))
    reach = frame.withColumn("_years", year_counts(lists)).select("window", F.explode(in_range).alias("e"))
    reach = reach.select("window", F.col("e.year").alias("r_year"))
    cells = fan_out(focal.join(reach, "window").join(other, "r_year"), "window", "f_block", "r_year", "r_block")
    side = lambda p: packed.select(
        F.col("year").alias(f"{p}_year"), F.col("block").alias(f"{p}_block"),
        *[F.col(c).alias(f"{p}_{c}") for c in ("ids", "n", "lens", "flat")],
    )
    cells = cells.withColumn("f_year", F.col("focal_year"))
    cells = cells.join(side("f"), ["f_year", "f_block"]).join(side("r"), ["r_year", "r_block"])
    cells = cells.select(
        "window", "focal_year", (F.col("r_year") < F.col("focal_year")).alias("is_back"),
        "f_ids", "f_lens", "f_flat", "r_lens", "r_flat", "r_n",
    )
    powers = [f"s{k}" for k in range(len(exponents))]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for window, year, back, ids, flens, fflat, rlens, rflat, n in batch.itertuples(index=False, name=None):
                sums = block_sums(
                    (np.asarray(flens), np.reshape(fflat, (-1, LEVELS))),
                    (np.asarray(rlens), np.reshape(rflat, (-1, LEVELS)), np.asarray(n)), exponents,
                )
                out = pd.DataFrame(sums, columns=powers)
                out.insert(0, "patent", ids)
                yield out.assign(window=window, focal_year=year, is_back=back)

    schema = "window string, focal_year int, is_back boolean, patent long, " + ", ".join(
        f"{c} double" for c in powers
    )
    entries = F.array(
        *[F.struct(F.lit(p).alias("exponent"), F.col(c).alias("s")) for p, c in zip(exponents, powers)]
    )
    long = cells.mapInPandas(kernel, schema).select(
        "window", "focal_year", "is_back", "patent", F.explode(entries).alias("e")
    )
    sums = long.groupBy("window", "focal_year", "patent", "e.exponent").agg(
        F.sum(F.when(F.col("is_back"), F.col("e.s"))).alias("sb"),
        F.sum(F.when(~F.col("is_back"), F.col("e.s"))).alias("sf"),
    )
    wanted = docs.join(frame, docs.year == frame.focal_year).select("window", "focal_year", "patent")
    wanted = wanted.withColumn("exponent", F.explode(F.array(*[F.lit(p) for p in exponents])))
    sums = wanted.join(sums, ["window", "focal_year", "patent", "exponent"], "left")
    p = F.col("exponent")
    mean = lambda s, n: power_mean(
        F.coalesce(F.col(s), F.when(F.col(n) > 0, F.lit(0.0))), F.col(n), p
    )
    return sums.join(sizes, "window", "left").select(
        "window", "exponent", "focal_year", "patent",
        mean("sb", "nb").alias("back"), mean("sf", "nf").alias("forward"),
    )
