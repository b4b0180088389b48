"""Readers and writers of document files: raw bundles, JSON lines, xz year files, Parquet by year."""

from __future__ import annotations

import io
import json
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as ST

from tidemark import schemas
from tidemark.functions.text import collapse_whitespace

# The line that opens a document of a raw bundle. Records are cut at the line break
# before "/Volumes/", which lets Spark split a bundle of any size.
RECORD_BREAK = "\n/Volumes/"
HEADER = r"^/Volumes/[^\n]*\d+-\d+/US\d+\.txt"
XZ_BATCH = 500


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give text work to all cores when a scan yields fewer partitions than there are cores.

    For a plain scan only. A scan of many row groups is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


# --- raw bundles ---------------------------------------------------------------------------------


def bundle_scan(
    spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Records ``value, path, block`` of all ``*.txt`` bundles below ``path``."""
    reader = spark.readStream if stream else spark.read
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = (
        reader.format("text")
        .schema("value STRING")
        .option("lineSep", RECORD_BREAK)
        .option("pathGlobFilter", "*.txt")
        .load(path)
    )
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def bundle_records(raw: DataFrame) -> DataFrame:
    """Decode latin-1 and restore the text the record break took away; ``rid`` orders a block."""
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    whole = F.when(text.startswith("/Volumes/"), text).otherwise(F.concat(F.lit("/Volumes/"), text))
    pieces = raw.withColumn("rid", F.monotonically_increasing_id()).select(
        "path", "block", "rid", F.posexplode(F.split(whole, "\r(?=/Volumes/)")).alias("part", "text")
    )
    return pieces.withColumn("is_head", F.col("text").rlike(HEADER))


def glue_strays(records: DataFrame) -> DataFrame:
    """Give lines that look like a header, but are none, back to the document before them.

    Rare: checked first, and without such lines the parse is a map without any shuffle. Only ids,
    not texts, are sorted, and never more than the ids of one file block at a time.
    """
    strays = records.where(~F.col("is_head"))
    if strays.isEmpty():
        return records.drop("is_head")
    at = F.struct("rid", "part")
    order = Window.partitionBy("path", "block").orderBy("rid", "part")
    blocks = strays.select("path", "block").distinct()
    owned = (
        records.join(blocks, ["path", "block"], "left_semi")
        .select("path", "block", "rid", "part", "is_head")
        .withColumn("owner", F.last(F.when(F.col("is_head"), at), ignorenulls=True).over(order))
        .where(~F.col("is_head"))
        .drop("is_head")
    )
    # a stray that opens its block belongs to the last header of the nearest earlier block
    tails = records.where("is_head").groupBy("path", F.col("block").alias("_b")).agg(F.max(at).alias("_tail"))
    earlier = (
        owned.where("owner IS NULL")
        .join(tails, "path")
        .where("_b < block")
        .groupBy("path", "block", "rid", "part")
        .agg(F.max_by("_tail", "_b").alias("owner"))
    )
    owners = owned.where("owner IS NOT NULL").unionByName(earlier)
    texts = strays.select("path", "block", "rid", "part", "text")
    extra = (
        texts.join(owners, ["path", "block", "rid", "part"])
        .groupBy("path", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("block", "rid", "part", "text"))).alias("s"))
        .select(
            "path", F.col("owner.rid").alias("rid"), F.col("owner.part").alias("part"),
            F.array_join("s.text", "").alias("_more"),
        )
    )
    heads = records.where("is_head").join(extra, ["path", "rid", "part"], "left")
    return heads.withColumn("text", F.concat("text", F.coalesce("_more", F.lit("")))).drop(
        "_more", "is_head"
    )


def record_columns(text: Column) -> list[Column]:
    """``patent, file, contents`` of a document's text, header line first."""
    file = F.regexp_extract(text, HEADER, 0)
    rest = F.substring(text, F.length(file) + 1, F.length(text))
    return [
        F.regexp_extract(file, r"US(\d+)\.txt$", 1).cast("long").alias("patent"),
        file.alias("file"),
        collapse_whitespace(F.regexp_replace(rest, "[\r\n]+", "")).alias("contents"),
    ]


def parse_bundles(raw: DataFrame) -> DataFrame:
    """A-1: ``(patent, file, contents)``; lines are joined without separator, empty texts kept."""
    return glue_strays(bundle_records(raw)).select(*record_columns(F.col("text")))


def read_raw_bundle(spark: SparkSession, path: str, years: DataFrame | None = None) -> DataFrame:
    """A-1, with the year lookup C-1 when ``years`` is given."""
    docs = parse_bundles(bundle_scan(spark, path))
    return docs if years is None else join_year(docs, years)


def join_year(docs: DataFrame, years: DataFrame) -> DataFrame:
    """C-1: publication year by id; NULL when unknown."""
    lookup = years.select(F.col("pat").alias("patent"), F.col("year").cast("int").alias("year"))
    return docs.join(lookup, "patent", "left")


# --- document files ------------------------------------------------------------------------------


def normal_year(docs: DataFrame) -> DataFrame:
    return docs.withColumn("year", F.nullif("year", F.lit(0)))


def read_jsonl(
    spark: SparkSession, path: str, schema: str = schemas.DOCUMENTS, pattern: str = "*.jsonl"
) -> DataFrame:
    """A-3: one JSON object per line."""
    return spark.read.schema(schema).option("pathGlobFilter", pattern).json(path)


def json_items(stream: io.TextIOBase, size: int = 1 << 20) -> Iterator[str]:
    """Source text of each item of one JSON array, without holding the array."""
    decoder = json.JSONDecoder()
    buffer, at, ended = stream.read(size), 0, False
    at = buffer.index("[") + 1 if "[" in buffer else len(buffer)
    while True:
        while at < len(buffer) and buffer[at] in " \t\r\n,":
            at += 1
        if at < len(buffer) and buffer[at] == "]":
            return
        try:
            _, end = decoder.raw_decode(buffer, at)
            yield buffer[at:end]
            at = end
        except json.JSONDecodeError:
            more = stream.read(max(size, len(buffer) - at))
            if not more:
                if ended or at < len(buffer):
                    raise
                return
            buffer, at = buffer[at:] + more, 0


def read_year_xz(spark: SparkSession, path: str, schema: str = schemas.DOCUMENTS) -> DataFrame:
    """A-2: LZMA files that hold one JSON array each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(path)
    return decode_year_files(files, schema)


def decode_year_files(files: DataFrame, schema: str = schemas.DOCUMENTS) -> DataFrame:
    """Documents of the compressed arrays in ``content``; each is decompressed as a stream."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with lzma.open(io.BytesIO(content), mode="rt", encoding="utf-8") as stream:
                    held: list[str] = []
                    for item in json_items(stream):
                        held.append(item)
                        if len(held) == XZ_BATCH:
                            yield pd.DataFrame({"doc": held})
                            held = []
                    yield pd.DataFrame({"doc": held}, dtype="object")

    fields = ST.StructType.fromDDL(schema)
    return files.select("content").mapInPandas(decode, "doc string").select(
        F.from_json("doc", fields).alias("d")
    ).select("d.*")


def read_documents(spark: SparkSession, path: str, schema: str = schemas.DOCUMENTS) -> DataFrame:
    """A-4: a file by its suffix, or all .jsonl and .xz files of a directory."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".xz"):
        return read_year_xz(spark, path, schema)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name.strip("."):
        raise ValueError(f"{path!r} is neither .jsonl nor .xz")
    return read_jsonl(spark, path, schema).unionByName(
        read_year_xz(spark, path, schema), allowMissingColumns=True
    )


def read_by_year(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by ``write_by_year``; a filter on ``year`` opens only those folders."""
    return spark.read.schema(schemas.DOCUMENTS).parquet(path)


def write_by_year(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A-9: Parquet folders by year, ids in order.

    Rebalancing gathers a year's rows and cuts a large year into several tasks and files.
    """
    (
        docs.hint("rebalance", "year")
        .sortWithinPartitions("year", "patent")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("year")
        .parquet(path)
    )


def new_documents(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """A-10: documents whose (year, id) is not stored.

    Of equal ids the first file wins, rows without a file come last, and rows of one file go by their other columns.
    """
    columns = [c for c in docs.columns if c not in ("year", "patent")]
    row = F.struct(*columns)
    fresh = docs.join(
        stored.select("year", "patent"),
        docs["patent"].eqNullSafe(stored["patent"]) & docs["year"].eqNullSafe(stored["year"]),
        "left_anti",
    )
    first = F.struct(F.col("file").isNull(), "file", *[c for c in columns if c != "file"])
    unique = fresh.groupBy("year", "patent").agg(F.min_by(row, first).alias("_row"))
    return unique.select(*[F.col(f"_row.{c}") if c in columns else F.col(c) for c in docs.columns])


def append_new_docs(docs: DataFrame, path: str) -> None:
    """A-10: add unseen documents to a store written by ``write_by_year``; old rows stay."""
    from tidemark.sources.store import path_exists

    spark = docs.sparkSession
    if path_exists(spark, path):
        stored = read_by_year(spark, path)
    else:
        stored = spark.createDataFrame([], schemas.DOCUMENTS)
    write_by_year(new_documents(docs, stored), path, mode="append")


def write_cleaned(docs: DataFrame, path: str, source: str = "file") -> None:
    """A-12: JSON lines, one folder per input file, named after it with ``_cleaned`` added."""
    name = F.concat(F.regexp_replace(F.col(source), r"^.*/|\.[^./]*$", ""), F.lit("_cleaned"))
    docs.withColumn("output", name).write.mode("overwrite").partitionBy("output").json(path)


def write_scores_csv(wide: DataFrame, path: str) -> None:
    """A-13: one CSV folder per kind of model, named by the last part of the model name, in id order.

    The full name stays as a column: models of one kind (with other preprocessors) share the folder.
    """
    classifier = F.element_at(F.split("model", "-"), -1)
    (
        wide.withColumn("classifier", classifier)
        .hint("rebalance", "classifier")
        .sortWithinPartitions("classifier", "model", "patent_ids")
        .write.mode("overwrite")
        .partitionBy("classifier")
        .csv(path, header=True)
    )
