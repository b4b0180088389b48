"""Merkle manifest of a table: a digest of every row, a tree over each group of rows and over the groups, and proofs.

Rows of a group stand by id, null ids first, rows of equal ids by their digests. While a level has several nodes, every
``ARITY`` consecutive ones (the last run has fewer, perhaps one) become the SHA-256 of their joined hexadecimal digests. What remains is
the group's subroot; subroots, by group name (null first, by bytes), become the root in the same way.

1. Digests of rows are column expressions; texts are read once and never shuffled. Positions come from ranges of (group, id), counted
   and added up.
2. Levels are built bottom up, a sixteenth of the rows each, and written as tables of coordinates (group, level, index, digest).
3. Octopus multiproof. The rows of a group are cut into parts of consecutive leaves. From the leaf indices of a
   part alone follows the least set of coordinates it cannot derive: level by level the other members of the runs it touches. All parts'
   sets are fetched once, by one join (levels of at most ``wide`` nodes are broadcast, the rest meets in a shuffle where no
   node is asked for by many parts).
4. A part derives its inner nodes from its own leaves and the fetched ones and writes out each row's proof from them: the
   siblings level by level, through the subroot to the root. A changed digest of a row can be folded up with these siblings.

A group of one row has no levels of its own, and a table of one group none above. Null values of fields have their own
mark, so they differ from empty texts; rows that are equal in all fields are leaves of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage

ARITY = 16


def encoded(value: Column) -> Column:
    """A field as its number of bytes and its value; a dash if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def place(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds idx, the place of each row in its group by ``order``, and size, the rows of the group.

    Rows are dealt by ranges of (group, order), so a large group lies on many tasks; the ranges of a group are counted and added up.
    """
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(F.col(group), *order, F.col("_row"))
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group)  # a row for each range
    before = F.sum("n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("n").over(own).alias("size"))
    nth = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_row"))
    placed = ranged.join(offsets, [group, "_range"]).withColumn("idx", (nth - 1 + F.col("_before")).cast("long"))
    return cut_lineage(placed.drop("_row", "_range", "_before"))


def next_level(nodes: DataFrame) -> DataFrame:
    """The nodes above (grp, idx, digest, size)."""
    runs = nodes.groupBy("grp", F.floor(F.col("idx") / ARITY).alias("above")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.first("size").alias("size")  # ARITY members at most
    )
    digest = F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest")
    return runs.select("grp", F.col("above").alias("idx"), digest, F.ceil(F.col("size") / ARITY).alias("size"))


def level_totals(placed: DataFrame) -> list[int]:
    """How many nodes each level has in all groups that do not end there."""
    size, sums = F.col("size"), []
    for level in range(16):  # 16^16 rows
        sums.append(F.sum(F.when(size > 1, size)).alias(f"n{level}"))
        size = F.ceil(size / ARITY)
    return [n for n in placed.where("idx = 0").agg(*sums).first() if n]


def build_levels(placed: DataFrame, totals: list[int]) -> tuple[list[DataFrame], DataFrame]:
    """The levels of nodes (grp, idx, digest) that have more above them, lowest first, and (grp, digest) of the last nodes."""
    current = placed.select("grp", "idx", "digest", "size")
    levels, tops = [], current.where("size = 1").select("grp", "digest")
    for _ in totals:
        levels.append(current.where("size > 1").select("grp", "idx", "digest"))
        current = cut_lineage(next_level(current.where("size > 1")))
        tops = tops.unionByName(current.where("size = 1").select("grp", "digest"))
    return levels, cut_lineage(tops)


def heights(size: int) -> list[int]:
    """How many nodes each level has that is not the last."""
    sizes = []
    while size > 1:
        sizes.append(size)
        size = -(-size // ARITY)
    return sizes


def missing(own: np.ndarray, size: int) -> list[np.ndarray]:
    """For each level, the indices that a holder of these leaves of a tree of ``size`` leaves cannot derive."""
    out = []
    for width in heights(size):
        runs = np.unique(own // ARITY)
        wanted = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        wanted = wanted[wanted < width]
        out.append(np.setdiff1d(wanted, own, assume_unique=True))
        own = runs
    return out


def fold(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Block:
    """The derived nodes of consecutive leaves of one tree, and what follows from them."""

    def __init__(self, first: int, digests: list[str], size: int, fetched: list[dict[int, str]]):
        self.levels: list[dict[int, str]] = []
        nodes = dict(zip(range(first, first + len(digests)), digests))
        for width, others in zip(heights(size), fetched):
            runs = sorted({i // ARITY for i in nodes})
            full = {**nodes, **others}
            self.levels.append(full)
            nodes = {r: fold([full[i] for i in range(r * ARITY, min((r + 1) * ARITY, width))]) for r in runs}
        self.top = nodes[min(nodes)] if self.levels else digests[0]
        self.size = size
        self.above: dict[tuple[int, int], list[str]] = {}

    def run(self, level: int, index: int) -> tuple[list[str], list[str]]:
        """The siblings of a node, before and after it."""
        start, full = index // ARITY * ARITY, self.levels[level]
        end = min(start + ARITY, heights(self.size)[level])
        return [full[i] for i in range(start, index)], [full[i] for i in range(index + 1, end)]

    def siblings(self, index: int, level: int = 0) -> str:
        """The siblings of a node and of all nodes above it, joined; remembered for inner nodes."""
        if level == len(self.levels):
            return ""
        if level == 0:
            before, after = self.run(0, index)
            return "".join([*before, *after]) + self.siblings(index // ARITY, 1)
        key = (level, index)
        if key not in self.above:
            before, after = self.run(level, index)
            self.above[key] = "".join([*before, *after]) + self.siblings(index // ARITY, level + 1)
        return self.above[key]

    def folded(self, index: int, digest: str) -> str:
        """The top that follows from a leaf's digest and the siblings of its place."""
        for level in range(len(self.levels)):
            before, after = self.run(level, index)
            digest, index = fold([*before, digest, *after]), index // ARITY
        return digest


def wanted_nodes(parts: DataFrame) -> DataFrame:
    """(grp, part, level, idx): the coordinates that parts (grp, part, first, last, size) of consecutive leaves cannot derive."""

    def run(batches):
        for batch in batches:
            for grp, part, first, last, size in zip(*(c.to_pylist() for c in batch.columns)):
                needed = missing(np.arange(first, last + 1), size)
                level = np.repeat(np.arange(len(needed)), [len(x) for x in needed])
                idx = np.concatenate(needed) if needed else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(idx), pa.string()), pa.array([part] * len(idx), pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())],
                    names=["grp", "part", "level", "idx"],
                )

    return parts.select("grp", "part", "first", "last", "size").mapInArrow(run, "grp string, part long, level int, idx long")


def fetch(wanted: DataFrame, levels: list[DataFrame], totals: list[int], wide: int) -> DataFrame:
    """The digests of the wanted coordinates."""
    out = None
    for level, (nodes, total) in enumerate(zip(levels, totals)):
        asked = wanted.where(F.col("level") == level)
        found = asked.join(F.broadcast(nodes) if total <= wide else nodes, ["grp", "idx"]).select("grp", "part", "level", "idx", "digest")
        out = found if out is None else out.unionByName(found)
    return out


RESULT = "id long, digest string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(leaves: DataFrame, block_size: int = 1024, wide: int = 1 << 16) -> DataFrame:
    """For each of the rows (grp, id, digest, changed): id, digest, subroot, root, proof_sha256, folded_root, verified.

    ``changed``: the digest to fold up in place of the row's own, null for its own. Group names are not null.
    """
    placed = place(leaves, "grp", [F.asc_nulls_first("id"), F.col("digest")])
    totals = level_totals(placed)
    levels, subroots = build_levels(placed, totals)
    named = place(subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "all", [F.encode("name", "utf-8")])
    named = named.select(F.col("all").alias("grp"), "name", "digest", "idx", "size")
    upper_totals = level_totals(named)
    upper_levels, roots = build_levels(named, upper_totals)
    last = roots.first()
    if last is None:
        return leaves.sparkSession.createDataFrame([], RESULT)
    root, groups, depth = last["digest"], named.first()["size"], len(levels)
    height = depth + len(upper_levels)

    part = F.floor(F.col("idx") / block_size)
    parts = placed.groupBy("grp", part.alias("part")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.first("size").alias("size"))
    parts = cut_lineage(parts.join(named.select(F.col("name").alias("grp"), F.col("idx").alias("place")), "grp"))
    head = F.concat_ws(",", "first", "size", "place")
    fetched = parts.select("grp", "part", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), head.alias("digest"))
    if levels:
        fetched = fetched.unionByName(fetch(wanted_nodes(parts), levels, totals, wide))
    if upper_levels:  # the groups are the leaves of the upper tree, each a part of one leaf
        lone = named.select("grp", F.col("idx").alias("part"), F.col("idx").alias("first"), F.col("idx").alias("last"), "size")
        upper = fetch(wanted_nodes(lone), upper_levels, upper_totals, wide).withColumnRenamed("part", "place").drop("grp")
        upper = parts.select("grp", "part", "place").join(upper, "place").withColumn("level", F.col("level") + depth)
        fetched = fetched.unionByName(upper.select("grp", "part", "level", "idx", "digest"))

    target = pa.schema([
        ("id", pa.int64()), ("digest", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
        ("folded_root", pa.string()), ("verified", pa.bool_()),
    ])

    def expand(own: pa.Table, others: pa.Table) -> pa.Table:
        first = size = at = 0
        nodes = [{} for _ in range(height)]
        for level, idx, digest in zip(*(others.column(c).to_pylist() for c in ("level", "idx", "digest"))):
            if level < 0:
                first, size, at = map(int, digest.split(","))
            else:
                nodes[level][idx] = digest
        own = own.sort_by("idx")
        digests, changed = own.column("digest").to_pylist(), own.column("changed").to_pylist()
        tree = Block(first, digests, size, nodes[:depth])
        top = Block(at, [tree.top], groups, nodes[depth:])
        shared = top.siblings(at)
        ends = {tree.top: top.folded(at, tree.top)}
        rows = []
        for i, (own_id, digest, other) in enumerate(zip(own.column("id").to_pylist(), digests, changed)):
            proof = hashlib.sha256((tree.siblings(first + i) + shared).encode()).hexdigest()
            subroot = tree.folded(first + i, digest if other is None else other)
            end = ends.get(subroot) or top.folded(at, subroot)
            rows.append((own_id, digest, tree.top, root, proof, end, end == root))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    mine = placed.withColumn("part", part).groupBy("grp", "part")
    return mine.cogroup(fetched.groupBy("grp", "part")).applyInArrow(expand, RESULT)


def manifest(
    df: DataFrame, fields: list[str], group_col: str = "source", id_col: str = "doc_id", changed: dict[str, Column] | None = None,
    when: Column | None = None, **options,
) -> DataFrame:
    """The proofs of a table's rows. ``changed``: other values of some fields, to be folded up in the rows ``when`` holds."""
    own = leaf_digest([F.col(c) for c in fields])
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(F.coalesce(when, F.lit(False)), leaf_digest([changed.get(c, F.col(c)) for c in fields]))
    # names keep the order of their bytes behind a sign, and null comes first
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = cut_lineage(df.select(group.alias("grp"), F.col(id_col).cast("long").alias("id"), own.alias("digest"), other.alias("changed")))
    return prove(leaves, **options)
