"""Exact copies by an extendible-hash index on shared files; DataFrame functions only.

Texts are equal when they are identical without ASCII white space. Their key is a 64-bit hash.

1. Directory. The distinct keys are counted by prefix. A bucket is a prefix of the key; while some bucket holds more than
   ``capacity`` keys the directory doubles: every overfull bucket is split by one more bit, the others are pointed to by
   both halves. It ends when nothing is overfull, or at ``deepest`` bits, where longer buckets are kept as they are (their keys are
   chained like all others, so nothing is lost). Rounds, keys and directory are tables in the shared folder.
2. Owners. Every row goes to the task that owns its bucket, a range of keys, with its whole normalised text. There the
   chain of a key is walked by comparing texts byte by byte (key first, then text), so texts that only share the
   key part ways; each group names the row that stays.
3. Hot chains. A key with more than ``hot_rows`` rows (and more than the rows / 2^18, so that at most 2^18 keys are hot: they
   are broadcast) is not sent to one owner. Each task folds its copies by key and text, and one row for each distinct
   text leaves it. Where the comparison of texts shows that all rows of the key have one text, its result goes back to the rows
   by key; a hot key that several texts share goes to its owner like others.

The row with the most code points in its original text stays, then the one with the smallest id; null ids come last. Of
rows that tie in both, one stays. Null texts count as empty texts, and the empty texts are a group like others. Columns other than
the two named are ignored. An empty table gives an empty table. Rows that repeat an id are each a row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage

WHITE = "\t\n\x0b\x0c\r "
PARTS = 1 << 18
LAST_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.coalesce(F.translate(text, WHITE, ""), F.lit(""))


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a key as a number; none of them is 0."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int, deepest: int = 20) -> tuple[DataFrame, int]:
    """(slot, bucket, depth, n) for the 2^g slots of the directory, and its global depth g.

    ``keys``: distinct 64-bit keys. A bucket's number is the first slot that points to it; n is how many keys it holds.
    """
    cells = cut_lineage(keys.groupBy(prefix(F.col("key"), deepest).alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    open_ = cut_lineage(cells.agg(F.lit(0).cast("long").alias("slot"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    closed: list[DataFrame] = []
    depth = 0
    while True:
        closed.append(open_.where(F.lit(depth >= deepest) | (F.col("n") <= capacity)).withColumn("depth", F.lit(depth)))
        full = open_.where(F.col("n") > capacity).select(F.col("slot").alias("above"))
        if depth >= deepest or full.isEmpty():
            break
        depth += 1
        halves = full.select(F.explode(F.array(F.col("above") * 2, F.col("above") * 2 + 1)).alias("slot"))
        counts = cells.groupBy(F.shiftright("cell", deepest - depth).alias("slot")).agg(F.sum("n").alias("n"))
        open_ = cut_lineage(halves.join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n")))
    buckets = closed[0]
    for part in closed[1:]:
        buckets = buckets.unionByName(part)
    first = F.expr(f"shiftleft(slot, {depth} - depth)")
    last = F.expr(f"shiftleft(slot + 1, {depth} - depth) - 1")
    slots = buckets.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "depth", "n")
    return cut_lineage(slots), depth


def keyed_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"), normalised(text).alias("body"))
    return rows.withColumn("key", F.xxhash64("body"))


def owned_groups(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """The groups of rows (doc_id, n_points, body, key) in the tasks that own their buckets."""
    slots = directory.select(F.col("slot").alias("_slot"), "bucket")  # 2^deepest slots at most
    owned = rows.withColumn("_slot", prefix(F.col("key"), depth)).join(F.broadcast(slots), "_slot").drop("_slot")
    owned = owned.repartition("bucket")
    chain = Window.partitionBy("bucket", "key", "body")
    best = chain.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    return owned.select(
        "doc_id", F.first("doc_id").over(best).alias("keep_id"), F.count(F.lit(1)).over(chain).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"), F.sha2("body", 256).alias("text_sha256"),
    )


def standing() -> Column:
    """How good a row is, as one number: code points, then a small id; no id is the least."""
    place = F.coalesce(F.lit(LAST_ID).cast("decimal(20,0)") - F.col("doc_id") + 1, F.lit(0))
    return (F.col("n_points").cast("decimal(12,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + place).cast("decimal(38,0)")


def folded_chains(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, group_size, text_sha256) of the hot keys whose rows all have one text: copies are folded where they are."""
    texts = rows.join(F.broadcast(hot), "key", "left_semi").groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"))
    chains = texts.select("key", "n", F.sha2("body", 256).alias("digest")).groupBy("key").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("group_size"), F.min("digest").alias("text_sha256")
    )
    return cut_lineage(chains.where("texts = 1").drop("texts"))


def folded_groups(light: DataFrame, folded: DataFrame) -> DataFrame:
    """The groups of folded chains, for rows (key, doc_id, standing, row) without their texts."""
    chained = light.join(F.broadcast(folded.select("key")), "key", "left_semi")
    best = chained.groupBy("key").agg(F.max("standing").alias("standing"))
    stays = chained.join(F.broadcast(best), ["key", "standing"]).groupBy("key").agg(
        F.min("row").alias("stays"), F.min("doc_id").alias("keep_id")
    )
    groups = folded.join(stays, "key")
    return light.join(F.broadcast(groups), "key").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "text_sha256"
    )


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, deepest: int = 20,
    hot_rows: int = 256,
) -> DataFrame:
    """One row per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 (of the normalised text).

    ``capacity`` None: 1,024 keys a bucket, more from 2^17 buckets on.
    """
    rows = keyed_rows(df, id_col, text_col)
    light = cut_lineage(rows.select("key", "doc_id", standing().alias("standing"), F.monotonically_increasing_id().alias("row")))
    counts = cut_lineage(light.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    directory, depth = build_directory(counts.select("key"), capacity or max(1024, sizes["keys"] >> 17), deepest)
    hot = cut_lineage(counts.where(F.col("n") > max(hot_rows, sizes["rows"] // PARTS)).select("key"))
    if hot.isEmpty():
        return owned_groups(rows, directory, depth)
    folded = folded_chains(rows, hot)  # PARTS keys at most
    others = rows.join(F.broadcast(folded.select("key")), "key", "left_anti")
    return owned_groups(others, directory, depth).unionByName(folded_groups(light, folded))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The ids of the rows that stay, one of each group."""
    return exact_groups(df, id_col, text_col, **options).where("kept").select("doc_id")
