"""Incremental ingest of raw bundles: each file once, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.documents import append_new_docs, bundle_scan, join_year, parse_bundles


def ingest_dir(
    spark: SparkSession, raw_dir: str, years: DataFrame, out_dir: str, checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """A-11: append the documents of unseen ``*.txt`` files to a store by year, then stop.

    The stream's checkpoint remembers the files. A batch that is run again after a failure adds
    nothing twice, since stored ids are skipped.
    """
    raw = bundle_scan(spark, raw_dir, stream=True, files_per_batch=files_per_batch)

    def append(batch: DataFrame, batch_id: int) -> None:
        append_new_docs(join_year(parse_bundles(batch), years), out_dir)

    query = (
        raw.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

