"""Bounded blocks of vectors, and the NumPy kernels that run on one block or one pair of blocks.

A block holds about ``rows`` documents of one group (model, window, year), chosen by id hash, so
neither a hot year nor a hot window ends up in one task. Kernels emit sums per document or per
group, never one row per pair of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

ROWS = 1024
CHUNK = 16384
SALTS = 32


def with_block(df: DataFrame, keys: list[str], rows: int, by: str = "patent", size: Column | None = None) -> DataFrame:
    """Add ``block``: a hash bucket of the document id sized by the count of the group, or by the sum of ``size``."""
    total = F.count(F.lit(1)) if size is None else F.sum(size)
    counts = df.groupBy(*keys).agg(F.ceil(total / rows).alias("_blocks"))
    return (
        df.join(counts, keys)
        .withColumn("block", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("long"))
        .drop("_blocks")
    )


def gather_dense(df: DataFrame, keys: list[str], vector: str, order: str = "patent") -> DataFrame:
    """One row per block: ``ids`` and ``flat``, the row-major matrix of the block."""
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in ("patent",) if c != order], vector)))
    return df.groupBy(*keys, "block").agg(rows.alias("rows")).select(
        *keys,
        "block",
        F.col("rows.patent").alias("ids"),
        F.flatten(F.col(f"rows.{vector}")).alias("flat"),
    )


def gather_sparse(df: DataFrame, keys: list[str], order: str = "patent") -> DataFrame:
    """One row per block from documents with arrays ``terms`` and ``ws``; flat, with row lengths."""
    extra = [c for c in ("patent",) if c != order]
    rows = F.sort_array(F.collect_list(F.struct(order, *extra, "terms", "ws")))
    return df.groupBy(*keys, "block").agg(rows.alias("rows")).select(
        *keys,
        "block",
        F.col("rows.patent").alias("ids"),
        F.transform("rows.terms", F.size).alias("lens"),
        F.flatten("rows.terms").alias("terms"),
        F.flatten("rows.ws").alias("flat"),
    )


def as_matrices(a: tuple, b: tuple, sparse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two blocks as matrices with the same columns; sparse ones use the terms of the first block."""
    if not sparse:
        (ids_a, flat_a), (ids_b, flat_b) = a, b
        return np.reshape(flat_a, (len(ids_a), -1)), np.reshape(flat_b, (len(ids_b), -1))
    ids_a, lens_a, terms_a, flat_a = a
    column = {t: k for k, t in enumerate(dict.fromkeys(terms_a))}

    def fill(ids, lens, terms, flat):
        out = np.zeros((len(ids), max(1, len(column))))
        rows = np.repeat(np.arange(len(ids)), lens)
        cols = np.fromiter((column.get(t, -1) for t in terms), dtype=np.int64, count=len(terms))
        known = cols >= 0
        out[rows[known], cols[known]] = np.asarray(flat)[known]
        return out

    return fill(ids_a, lens_a, terms_a, flat_a), fill(*b)


def power_sums(similarity: np.ndarray, exponents: list[float]) -> np.ndarray:
    """Row sums of ``similarity ** p``, one column per exponent."""
    clipped = np.maximum(similarity, 0.0)
    return np.stack([(clipped**p).sum(axis=1) for p in exponents], axis=1)


# --- moments -----------------------------------------------------------------------------------


def moment_vector(v: np.ndarray) -> np.ndarray:
    """Count, sum and sum of outer products, concatenated."""
    return np.concatenate([np.array([float(len(v))]), v.sum(axis=0), (v.T @ v).ravel()])


# Sums of products of up to three components are held in slabs, one for each first component i: the sum of v[i], of
# v[i] * v, and of v[i] * v[j] * v[k] for j, k >= i. A group of neighbouring slabs, with the count, is one row of a
# table and has a key of its own, so a task never holds more of the dim^3 / 3 numbers than one group.


def slab_size(dim: int, first: int, order: int) -> int:
    return 1 + (dim if order >= 2 else 0) + ((dim - first) ** 2 if order >= 3 else 0)


def slab_groups(dim: int, order: int, budget: int) -> list[tuple[int, int]]:
    """Ranges of first components whose slabs hold at most ``budget`` numbers together; a larger slab stands alone."""
    groups, start, held = [], 0, 0
    for i in range(dim):
        size = slab_size(dim, i, order)
        if i > start and held + size > budget:
            groups.append((start, i))
            start, held = i, 0
        held += size
    return [*groups, (start, dim)]


def slab_sums(v: np.ndarray, start: int, stop: int, order: int) -> np.ndarray:
    """The count of the rows and their slabs from ``start`` to ``stop``, concatenated."""
    parts = [np.array([float(len(v))])]
    for i in range(start, stop):
        x, rest = v[:, i], v[:, i:]
        parts.append(np.array([x.sum()]))
        if order >= 2:
            parts.append(x @ v)
        if order >= 3:
            parts.append(((rest * x[:, None]).T @ rest).ravel())
    return np.concatenate(parts)


def slab_powers(u: np.ndarray, sums: np.ndarray, start: int, stop: int, order: int) -> np.ndarray:
    """What the slabs add to the sums of (u.v)^k, for k = 1..order, one column each.

    Of the products of three components each slab holds those whose first is the least, so the others count for their
    permutations: three times where all differ from it, less on the first row and column.
    """
    out = np.zeros((len(u), order))
    dim, at = u.shape[1], 1
    for i in range(start, stop):
        x, rest, width = u[:, i], u[:, i:], dim - i
        out[:, 0] += x * sums[at]
        at += 1
        if order >= 2:
            out[:, 1] += x * (u @ sums[at : at + dim])
            at += dim
        if order >= 3:
            slab = sums[at : at + width * width].reshape(width, width)
            at += width * width
            row = x * (rest @ slab[0])
            out[:, 2] += x * (3 * ((rest @ slab) * rest).sum(axis=1) - 3 * row + x * x * slab[0, 0])
    return out


def slab_moments(blocks: DataFrame, keys: list[str], groups: list[tuple[int, int]], order: int, together: int = 64) -> DataFrame:
    """(keys, slab, vals): the sums of each group of slabs over the documents of each key.

    A block goes to one task for each group of slabs; up to ``together`` blocks are added up as they arrive, then those sums.
    """
    slab = F.explode(F.lit(list(range(len(groups))))).alias("slab")
    cells = blocks.select(*keys, slab, F.floor(F.col("block") / together).alias("salt"), F.size("ids").alias("n"), "flat")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [*keys, "slab", "salt"]
            for key, g, n, flat in zip(batch[names].itertuples(index=False, name=None), batch["slab"], batch["n"], batch["flat"]):
                # one row at a time: the sums of a block may be larger than the block
                yield pd.DataFrame([(*key, slab_sums(np.reshape(flat, (n, -1)), *groups[g], order))], columns=[*names, "vals"])

    fields = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, "slab", "salt"]) + ", vals array<double>"
    once = sum_chunks(cells, [*keys, "slab", "salt"], lambda df: df.mapInPandas(kernel, schema))
    return sum_chunks(once, [*keys, "slab"])


def group_moments(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Moment vectors summed per group and salt, as chunks ``(keys, chunk, salt, vals)``.

    A task adds up the blocks it sees before it emits anything, and the salts split the merge of
    these partial vectors; the caller adds up the at most SALTS rows per group and chunk.
    """
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in keys]
        + ["chunk int", "salt int", "vals array<double>"]
    )
    names = [f.name for f in blocks.schema if f.name in keys]

    def emit(sums: dict) -> pd.DataFrame:
        salt = TaskContext.get().partitionId() % SALTS
        rows = [
            (*key, c, salt, vec[s : s + CHUNK])
            for key, vec in sums.items()
            for c, s in enumerate(range(0, len(vec), CHUNK))
        ]
        return pd.DataFrame(rows, columns=[*names, "chunk", "salt", "vals"])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        held = 0
        for batch in batches:
            for key, ids, flat in zip(
                batch[names].itertuples(index=False, name=None), batch["ids"], batch["flat"]
            ):
                vec = moment_vector(np.reshape(flat, (len(ids), -1)))
                if key in sums:
                    sums[key] += vec
                else:
                    sums[key] = vec
                    held += vec.nbytes
                if held > 1 << 27:
                    yield emit(sums)
                    sums, held = {}, 0
        if sums:
            yield emit(sums)

    partial = blocks.select(*names, "ids", "flat").mapInPandas(kernel, schema)
    return sum_chunks(partial, [*keys, "chunk", "salt"])


def sum_chunks(df: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Element-wise sum of the equally long arrays ``vals`` of each group.

    Rows arrive sorted by group and are added up as they come, so a task holds one running sum. ``make`` turns the rows into
    such arrays where they have arrived.
    """
    if make is not None:
        ordered = make(df.repartition(*keys).sortWithinPartitions(*keys))
        df = ordered
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + ["vals array<double>"])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total = None, None
        for batch in batches:
            done, size = [], 0
            for key, vals in zip(batch[keys].itertuples(index=False, name=None), batch["vals"]):
                if key == current:
                    total += vals
                else:
                    if current is not None:
                        done.append((*current, total))
                        size += len(total)
                    current, total = key, np.array(vals, dtype=float)
                if size > CHUNK << 5:  # 4 MB
                    yield pd.DataFrame(done, columns=[*keys, "vals"])
                    done, size = [], 0
            if done:
                yield pd.DataFrame(done, columns=[*keys, "vals"])
        if current is not None:
            yield pd.DataFrame([(*current, total)], columns=[*keys, "vals"])

    if make is None:
        ordered = df.select(*keys, "vals").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(kernel, schema)


def join_chunks(chunk: Column, vals: Column) -> Column:
    """Aggregate that puts the chunks of a vector back together."""
    parts = F.sort_array(F.collect_list(F.struct(chunk.alias("chunk"), vals.alias("vals"))))
    return F.flatten(F.transform(parts, lambda p: p["vals"]))
