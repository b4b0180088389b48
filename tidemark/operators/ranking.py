"""Exact positions and ranks inside groups of any size.

``row_number() over (partition by group)`` pulls a whole group into one task. Here the order is
taken from a 64-bit key: buckets of the key are counted, a prefix sum over 16 bits at a time gives
every bucket its offset, and only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BITS = 16


def bucket_offsets(counts: DataFrame, group: list[str], levels: int) -> DataFrame:
    """Add ``before``: the total ``n`` of the smaller buckets of the same group."""
    if levels <= 1:
        order = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    counts = counts.withColumn("parent", F.shiftright("bucket", BITS))
    parents = counts.groupBy(*group, F.col("parent").alias("bucket")).agg(F.sum("n").alias("n"))
    parents = bucket_offsets(parents, group, levels - 1).select(
        *group, F.col("bucket").alias("parent"), F.col("before").alias("above")
    )
    order = (
        Window.partitionBy(*group, "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return inner.join(parents, [*group, "parent"]).select(
        *group, "bucket", "n", (F.col("inner") + F.col("above")).alias("before")
    )


def with_position(
    df: DataFrame, group: list[str], key: str, out: str = "pos", levels: int = 2, upto: int | None = None
) -> DataFrame:
    """Add the zero-based position of each row in its group, ordered by the long column ``key``.

    With ``upto``, buckets that start at that position or later are left out before their rows are joined or sorted.

    ``levels`` prefix sums of 16 bits sit above the 16 bits sorted inside a bucket: 2 keep every
    task bounded for keys below 2^48.
    """
    bucketed = df.withColumn("bucket", F.shiftright(key, BITS))
    counts = bucketed.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = bucket_offsets(counts, group, levels).select(*group, "bucket", "before")
    if upto is not None:
        offsets = offsets.where(F.col("before") < upto)
    order = Window.partitionBy(*group, "bucket").orderBy(key)
    return (
        bucketed.join(offsets, [*group, "bucket"])
        .withColumn(out, (F.row_number().over(order) - 1 + F.col("before")).cast("long"))
        .drop("bucket", "before")
    )


def first_n(df: DataFrame, group: list[str], key: str, n: int, levels: int = 2) -> DataFrame:
    """The ``n`` rows with the smallest key of every group."""
    return with_position(df, group, key, "_pos", levels, upto=n).where(F.col("_pos") < n).drop("_pos")


def monotone_key(value: Column) -> Column:
    """A long that never decreases with the double.

    The logarithm of 1 + |x| is semi-monotonic, at most 710, and tells large values apart by their ratio, so it has no
    range where different values pile up.
    """
    size = F.floor(F.log1p(F.abs(value)) * float(1 << 52)).cast("long")
    return F.when(value < 0, -size).otherwise(size)


def tie_averaged_ranks(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct (group, value) with its count ``n`` and average rank ``rank``.

    ``weight`` names a column that says for how many rows a row stands.
    """
    values = df.groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    values = values.withColumn("bucket", F.shiftright(monotone_key(F.col(value)), BITS))
    counts = values.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    offsets = bucket_offsets(counts, group, levels=3).select(*group, "bucket", "before")
    order = (
        Window.partitionBy(*group, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    smaller = F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0))
    return values.join(offsets, [*group, "bucket"]).select(
        *group, value, "n", (smaller + (F.col("n") + 1) / 2.0).alias("rank")
    )
