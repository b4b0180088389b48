"""Exact top-k by inner product over integer vectors.

Vectors become integers (floor(scale * x)), are put in order of descending length and packed into blocks of bounded size. A
rotation from the singular vectors of all vectors moves most of the length into the first coordinates. Every query
first meets the block of the longest vectors, which gives it a score that its k-th best has at least. Then pairs of a query
block and a vector block are compared, unless the product of their greatest lengths cannot reach the least such
score. In a pair, vectors come in descending length: queries whose length times the next vector's length is too small
stop, the first rotated coordinates and the lengths of the rest (Cauchy-Schwarz) bound every score, and only what the
bound lets through is multiplied out, in integers. All bounds have a margin for rounding, so no result is lost.

The query set against all rows is compared in blocks; a pair of blocks leaves at most k rows per query.

Vectors that are null, or hold null or non-finite components, and rows with a null id take no part. Vectors meet those of their own
dimension only; empty vectors score 0 with each other. Candidates of the query's own id are left out, so a repeated id
is never its own result; as candidates, repeated rows all count. Queries that are equal in id and vector are one query, and
queries that share only the id get a list each. Ties go to the smaller id. Scores beyond 2^63 are not defined. Extra columns
are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage

BLOCK = "dim int, block long, ids binary, data binary, longest double"
RESULT = "query_key long, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim, length) of the rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(squares).alias("length"))


def gram_matrix(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sum of all outer products of a dimension; each task adds up its own first."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.asarray(batch.column(0).combine_chunks().flatten() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0).flatten())
            x = x.reshape(-1, dim).astype(np.float64)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    rows = vectors.where(F.col("dim") == dim).select("v").mapInArrow(run, "i long, j long, s double")
    out = np.zeros((dim, dim))
    for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():  # dim * dim numbers
        out[r["i"], r["j"]] = r["s"]
    return out


def pack(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors, in descending length inside a range of lengths."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.repartitionByRange(parts, "dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id")

    def run(batches):
        held: list[tuple] = []
        number = 0

        def block():
            nonlocal number
            number += 1
            dim = held[0][3]
            data = np.array([r[1] for r in held], np.int64).reshape(len(held), dim)
            ids = np.array([r[0] for r in held], np.int64)
            row = [dim], [held[0][4] << 32 | number], [ids.tobytes()], [data.tobytes()], [held[0][2]]
            kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=["dim", "block", "ids", "data", "longest"])

        for batch in batches:
            for vec_id, v, length, dim, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= size or held[0][3] != dim):
                    yield block()
                held.append((vec_id, v, length, dim, part))
        if held:
            yield block()

    columns = ordered.select("vec_id", "v", "length", "dim", F.spark_partition_id().cast("long").alias("part"))
    return columns.mapInArrow(run, BLOCK)


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(data, np.int64).reshape(len(numbers), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: as floats where they are exact, else in whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def best_of(q_ids, queries, least, ids, vectors, k: int, rotation: np.ndarray, head: int, step: int = 512):
    """For each query up to k (score, id) among vectors in descending length, best first, none of its own id."""
    q, v = queries @ rotation, vectors @ rotation
    q_len, v_len = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    q_rest, v_rest = np.sqrt((q[:, head:] ** 2).sum(1)), np.sqrt((v[:, head:] ** 2).sum(1))
    least = least.astype(np.float64).copy()
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
    for start in range(0, len(vectors), step):
        part = slice(start, start + step)
        margin = 1e-6 * (1 + q_len * v_len[part].max(initial=0))
        alive = np.flatnonzero(q_len * v_len[part].max(initial=0) + margin >= least)
        if not len(alive):
            break  # what follows is shorter still
        bound = q[alive, :head] @ v[part, :head].T + q_rest[alive, None] * v_rest[None, part]
        may = (bound + margin[alive, None] >= least[alive, None]) & (q_ids[alive, None] != ids[None, part])
        rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            continue
        scores = products(queries[alive[rows]], vectors[part][columns])
        for r, row in enumerate(rows):
            place = alive[row]
            own = np.flatnonzero(may[row, columns] & (scores[r] >= least[place]))
            if len(own):
                near = ids[part][columns[own]]
                order = np.lexsort((near, -scores[r, own]))[:k]
                merged = sorted([*found[place], *((-int(scores[r, own[o]]), int(near[o])) for o in order)])[:k]
                found[place] = merged
                if len(merged) == k:
                    least[place] = max(least[place], -merged[-1][0])
    return found


def top_k(
    df: DataFrame, queries: Column, k: int = 5, scale: int = 256, block: int = 4096, query_block: int = 2048, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row for which ``queries`` holds."""
    vectors = cut_lineage(integer_vectors(df.select(id_col, vector_col), scale, id_col, vector_col))
    blocks = cut_lineage(pack(vectors, block))
    asked = vectors.join(df.where(queries).select(F.col(id_col).alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = cut_lineage(pack(asked.dropDuplicates(["vec_id", "v"]), query_block))

    # the rotation of the commonest dimension; vectors of another are compared without one
    common = vectors.where("dim > 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    rotations, heads = {}, {}
    if common:
        dim = common["dim"]
        values, axes = np.linalg.eigh(gram_matrix(vectors, dim))
        order = np.argsort(-values)
        share = np.cumsum(np.maximum(values[order], 0)) / max(values.clip(0).sum(), 1e-300)
        rotations[dim], heads[dim] = axes[:, order], min(int(np.searchsorted(share, 0.8)) + 1, dim)

    def compare(q: pd.Series, v: pd.Series, least: np.ndarray):
        dim = int(q["dim"])
        q_ids, q_data = unpack(q["ids"], q["data"], dim)
        v_ids, v_data = unpack(v["ids"], v["data"], dim)
        rotation = rotations.get(dim)
        if rotation is None:
            rotation = np.eye(dim)
        return q_ids, best_of(q_ids, q_data, least, v_ids, v_data, k, rotation, heads.get(dim, dim))

    first = blocks.groupBy("dim").agg(F.max_by("block", F.struct("longest", "block")).alias("block"))
    first = blocks.join(F.broadcast(first), ["dim", "block"]).select("dim", F.col("ids").alias("v_ids"), F.col("data").alias("v_data"))

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        q = group.iloc[0]
        v = pd.Series({"ids": q["v_ids"], "data": q["v_data"]})
        _, found = compare(q, v, np.full(len(q["ids"]) // 8, -np.inf))
        least = np.array([-f[-1][0] if len(f) == k else -np.inf for f in found], np.float64)
        return pd.DataFrame({"dim": [q["dim"]], "query": [q["block"]], "ids": [q["ids"]], "data": [q["data"]], "least": [least.tobytes()],
                             "q_longest": [q["longest"]], "lowest": [least.min()]})

    kind = "dim int, query long, ids binary, data binary, least binary, q_longest double, lowest double"
    known = cut_lineage(asked.join(first, "dim").groupBy("block").applyInPandas(bound, kind))
    # names of block pairs only; the query set meets all rows block by block, less the pairs that cannot reach a result
    pairs = known.select("dim", "query", "q_longest", "lowest").join(blocks.select("dim", "block", "longest"), "dim").where(
        F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("lowest")
    )
    pairs = cut_lineage(pairs.select("query", "block"))
    left = pairs.join(known.drop("q_longest", "lowest"), "query")
    right = pairs.join(blocks.drop("longest", "dim"), "block")
    right = right.select(F.col("query").alias("to"), F.col("block").alias("of"), "ids", "data")

    def search(q_rows: pd.DataFrame, v_rows: pd.DataFrame) -> pd.DataFrame:
        q, v = q_rows.iloc[0], v_rows.iloc[0]
        q_ids, found = compare(q, v, np.frombuffer(q["least"], np.float64))
        out = [(int(q["query"]) * query_block + i, int(q_ids[i]), vec, -minus) for i, f in enumerate(found) for minus, vec in f]
        return pd.DataFrame(out, columns=["query_key", "query_id", "vec_id", "score"]).astype("int64")

    scored = left.groupBy("query", "block").cogroup(right.groupBy("to", "of")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
