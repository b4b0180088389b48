"""N-gram Jaccard join: MinHash bands find candidate pairs, the full n-gram sets decide.

1. Every text becomes the set of hashes of its word n-grams (five words; lower case, letters and digits only). Texts
   with equal sets are one class; a class is represented by its lowest id and joined as one text.
2. The number of rows in a band, and of bands, follows from the similarity and the target recall: the longest bands for
   which 1 - (1 - s^r)^b reaches the recall within the given number of hash functions.
3. (band, hash) keys are counted. Keys of one representative are dropped; the others hold candidates.
4. The members of a key are dealt by id into blocks of bounded size, and every pair of blocks is a task row of its own
   key. There, the n-gram sets are compared as a whole (shared n-grams by a matrix product); a pair counts where its
   first common band is. What leaves a pair of blocks is, for each representative, the number of its links there and one
   edge to the lowest representative it reaches; so no row per pair is ever made.
5. Classes are the connected components of the edges: large-star and small-star rounds, each written to the shared folder.

Texts with fewer words than n have one n-gram, all their words. Null texts, empty texts and texts without a word have no
n-grams; each is a class of its own with no links. Rows with a null id take no part. A repeated id counts as one
document with each of its texts linked for itself; its row carries its lowest class. Ties between representatives go to the
lowest id. Columns other than the two named are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import release
from tidemark.session import cut_lineage

WORD = re.compile(r"[^\W_]+").findall
PRIME = (1 << 61) - 1


def choose_bands(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair of the given similarity with the given probability."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = WORD(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    codes = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        n = len(words)
    size = len(codes) - n + 1
    mixed = np.zeros(size, np.uint64)
    for k in range(n):
        mixed = (mixed ^ codes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def permutations(hashes: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, hashes, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, hashes, np.uint64)


def signature(found: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least 32-bit value of the set under each hash function, a bounded slice of the set at a time."""
    least = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(found), 1024):
        part = found[start : start + 1024, None] * mult + add
        least = np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(0))
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = least[: bands * rows].reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), seed=b) for b, p in enumerate(parts)], np.uint64).view(np.int64)


def sign_texts(df: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set_hash, bands): the digest of the n-gram set, null if it is empty, and the hashes of the bands."""
    mult, add = permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                digests, hashes = [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, n)
                    digests.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                    hashes.append(band_hashes(signature(found, mult, add), bands, rows) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["id", "set_hash", "bands"],
                )

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return kept.mapInArrow(run, "id long, set_hash string, bands array<long>")


def shared_counts(sets: list[np.ndarray], width: int = 1 << 22) -> np.ndarray:
    """The sizes of all pairwise intersections of a bounded number of sets."""
    size = len(sets)
    shared = np.zeros((size, size), np.float32)
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # only n-grams that occur twice can be shared
    keep = times[place] > 1
    owner, place = owner[keep], column[place[keep]]
    total = int((times > 1).sum())
    step = max(1, width // max(size, 1))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, total, step):
        a, b = np.searchsorted(place, (start, start + step))
        slab = np.zeros((size, min(step, total - start)), np.float32)
        slab[owner[a:b], place[a:b] - start] = 1
        shared += slab @ slab.T
    return shared


def lowest_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a link matrix, the lowest index in its component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify_blocks(members: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links inside and between two blocks of one key: (id, links, low) for members that have a link.

    ``members``: band, key, left, right (numbers of the two blocks), block, id, bands, text.
    """

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        sets = [shingles(t, n) for t in group["text"]]
        shared, sizes = shared_counts(sets), np.array([len(s) for s in sets], np.float32)
        linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-4
        band, signs = int(group["band"].iloc[0]), np.stack(group["bands"].to_numpy())
        for earlier in range(band):  # the pair is counted in its first common band
            linked &= signs[:, earlier, None] != signs[None, :, earlier]
        block, left, right = group["block"].to_numpy(), group["left"].iloc[0], group["right"].iloc[0]
        if left != right:  # pairs inside a block are counted where it meets itself
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        found = linked.any(1)
        ids = group["id"].to_numpy()
        return pd.DataFrame({"id": ids[found], "links": linked.sum(1)[found], "low": ids[lowest_reached(linked)[found]]})

    return members.groupBy("band", "key", "left", "right").applyInPandas(verify, "id long, links long, low long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, low): the lowest id of each id's component, for ids that have an edge (``a``, ``b``).

    Large-star links every larger neighbour of a node to its least neighbour, small-star the smaller ones; both until the
    edges are stars. Each round is written, so an executor that is lost costs no earlier round.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = least(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("low"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("low")).distinct()
    return nodes.unionByName(roots).groupBy("id").agg(F.min("low").alias("low"))


def near_join(
    df: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, hashes: int = 128, block: int = 256,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id (lowest id of its component), set_id (lowest id with the same n-gram set),
    n_copies (documents of that set), n_links (other sets that are similar enough)."""
    bands, rows = choose_bands(similarity, recall, hashes)
    signed = cut_lineage(sign_texts(df, n, bands, rows, id_col, text_col))
    sets = signed.where("set_hash IS NOT NULL").groupBy("set_hash").agg(
        F.min("id").alias("set_id"), F.countDistinct("id").alias("n_copies")
    )
    sets = cut_lineage(sets)
    reps = signed.join(sets.select("set_hash", F.col("set_id").alias("id")), ["set_hash", "id"]).select("id", "set_hash", "bands")
    reps = cut_lineage(reps.dropDuplicates(["set_hash"]))
    keyed = reps.select("id", "set_hash", F.posexplode("bands").alias("band", "key"))
    members = keyed.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("size"), *(F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"_{k}") for k in (1, 2))
    ).where("size > 1")
    # keys of the same members: the first band's is enough, as no pair has its first common band in another
    shared = members.groupBy("size", "_1", "_2").agg(F.min(F.struct("band", "key")).alias("_at"))
    shared = shared.select("_at.*", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    found = cut_lineage(keyed.join(shared, ["band", "key"]).select("band", "key", "id", "set_hash", "blocks"))
    mine = F.pmod(F.xxhash64("set_hash"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = found.withColumn("block", mine).withColumn("other", other)
    dealt = dealt.select("band", "key", "id", "set_hash", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    needed = found.select("id", "set_hash").distinct().join(reps, ["id", "set_hash"])
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # an id that repeats is told apart by its text's set
    texts = cut_lineage(_with_sets(texts.join(needed.select("id").distinct(), "id", "left_semi"), n).join(needed, ["id", "set_hash"])
                        .dropDuplicates(["set_hash"]))
    members = dealt.join(texts, ["id", "set_hash"]).select("band", "key", "left", "right", "block", "id", "bands", "text")
    verified = cut_lineage(verify_blocks(members, n, similarity))
    links = verified.groupBy("id").agg(F.sum("links").alias("n_links"))
    lows = components(verified.select(F.col("id").alias("a"), F.col("low").alias("b")))
    by_set = sets.join(links.withColumnRenamed("id", "set_id"), "set_id", "left").join(
        lows.select(F.col("id").alias("set_id"), "low"), "set_id", "left"
    )
    per_set = by_set.select("set_hash", "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("low", "set_id").alias("class_id"))
    with_set = signed.where("set_hash IS NOT NULL").select("id", "set_hash").join(per_set, "set_hash").drop("set_hash")
    alone = signed.where("set_hash IS NULL").select(
        "id", F.col("id").alias("set_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"),
        F.col("id").alias("class_id"),
    )
    return with_set.unionByName(alone).groupBy(F.col("id").alias("doc_id")).agg(
        F.min("class_id").alias("class_id"), F.min("set_id").alias("set_id"),
        F.max("n_copies").alias("n_copies"), F.max("n_links").alias("n_links"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, of one document of each class, the one of the lowest id; rows without an id stay.

    Where ids repeat, each distinct text of an id is a document of its own, and one row of it stays: ties between texts of
    the lowest id and between rows of the same id and text go by a hash of their values.
    """
    options = {**options, "id_col": id_col, "text_col": text_col}
    if df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        others = near_join(df, **options).where("doc_id != class_id").select(F.col("doc_id").alias("_other"))
        return df.join(others, F.col(id_col) == F.col("_other"), "left_anti")
    rows = df.where(F.col(id_col).isNotNull())
    # copies are folded where they are; the row of each (id, text) that would stay
    rows = rows.groupBy(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).agg(
        F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("_row"), F.xxhash64(F.first(F.col(text_col))).alias("_tie")
    )
    rows = cut_lineage(rows.withColumn("_node", F.monotonically_increasing_id()))
    joined = near_join(rows.select(F.col("_node").alias("doc_id"), F.col("_text").alias("text")), **{**options, "id_col": "doc_id", "text_col": "text"})
    found = rows.select("_id", "_tie", "_node").join(joined.select(F.col("doc_id").alias("_node"), "class_id"), "_node")
    stays = found.groupBy("class_id").agg(F.min(F.struct("_id", "_tie", "_node")).alias("_best")).select(F.col("_best._node").alias("_node"))
    return rows.join(stays, "_node", "left_semi").select("_row.*").unionByName(df.where(F.col(id_col).isNull()))


def _with_sets(texts: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, n) for t in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_hexdigest(f.tobytes()) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["id", "text", "set_hash"])

    return texts.mapInArrow(run, "id long, text string, set_hash string")
