"""Year windows, their documents, and the focal / back / forward frames of the scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.vectors import hash60
from tidemark.operators.ranking import first_n, with_position

FIRST_YEAR = 1838  # fixed value: windows are aligned to this year


@dataclass(frozen=True)
class WindowSpec:
    """Which windows a run covers and how much of them it samples."""

    year_start: int
    year_end: int
    size: int = 1
    shift: int | None = None
    pairs_per_doc: int = 10
    max_docs_per_year: int | None = None
    docs_per_window: int | None = None

    @property
    def step(self) -> int:
        return (self.size + 1) // 2 if self.shift is None else self.shift

    @property
    def name(self) -> str:
        """Identity of a run; start, end and shift are free to differ between compatible runs."""
        return (
            f"s{FIRST_YEAR}-w{self.size}-c{self.pairs_per_doc}"
            f"-d{self.max_docs_per_year}-n{self.docs_per_window}"
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        """S-11, S-12: ``windows(window, start, end)``."""
        first = self.year_start - (self.year_start - FIRST_YEAR) % self.step
        n = max(0, (self.year_end - self.size - first) // self.step + 1)
        start = (F.lit(first) + F.col("id") * self.step).cast("int")
        return (
            spark.range(n)
            .select(start.alias("start"), (start + (self.size - 1)).cast("int").alias("end"))
            .select(F.concat_ws("-", "start", "end").alias("window"), "start", "end")
        )


def window_years(windows: DataFrame) -> DataFrame:
    """One row per window and year. As small as the run specification."""
    return windows.select("window", F.explode(F.sequence("start", "end")).alias("year"))


def assign_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """C-5: copy each document to the windows that contain its year, as an equi-join."""
    return docs.join(window_years(windows), "year")


def docs_in_window(docs: DataFrame, window_docs: DataFrame) -> DataFrame:
    """C-4: keep documents that a window lists."""
    return docs.join(window_docs.select("patent").distinct(), "patent", "left_semi")


def window_positions(window_docs: DataFrame) -> DataFrame:
    """W-4: position of a document in its window, by year and then id."""
    per_year = window_docs.groupBy("window", "year").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("window").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_year.select(
        "window", "year", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_first")
    )
    ranked = with_position(window_docs, ["window", "year"], "patent")
    return (
        ranked.join(shift, ["window", "year"])
        .withColumn("pos", F.col("pos") + F.col("_first"))
        .drop("_first")
    )


def limit_per_year(docs: DataFrame, n: int) -> DataFrame:
    """T-3: the first ``n`` documents of every year file, in id order."""
    return first_n(docs, ["year"], "patent", n)


def sample_window(window_docs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """P-1: ``n`` documents of each window, without replacement, by seeded hash."""
    keyed = window_docs.withColumn("_key", F.shiftright(hash60(F.col("window"), F.col("patent"), seed=seed), 12))
    return first_n(keyed, ["window"], "_key", n).drop("_key")


def reach_columns(reach: int | tuple[int, int] | None) -> tuple[Column, Column]:
    focal, low, high = F.col("focal_year"), F.col("min_year"), F.col("max_year")
    if reach is None:
        return F.lit(1), F.greatest(focal - low, high - focal)
    nearest, farthest = (1, reach) if isinstance(reach, int) else reach
    return F.lit(nearest), F.lit(farthest)


def focal_years(
    window_docs: DataFrame, reach: int | tuple[int, int] | None = None
) -> DataFrame:
    """B-4: middle of the years present in each window, and how far back and forward to look."""
    spans = window_docs.groupBy("window").agg(
        F.min("year").alias("min_year"), F.max("year").alias("max_year")
    )
    spans = spans.withColumn("focal_year", ((F.col("min_year") + F.col("max_year")) / 2).cast("int"))
    nearest, farthest = reach_columns(reach)
    return spans.select(
        "window", "focal_year", nearest.cast("int").alias("w0"), farthest.cast("int").alias("w1")
    )


def frames(focal: DataFrame) -> DataFrame:
    """B-3 as rows: ``(window, focal_year, side, year)`` for the focal year and both ranges."""
    f, w0, w1 = F.col("focal_year"), F.col("w0"), F.col("w1")
    years = lambda low, high: F.when(low <= high, F.sequence(low, high))
    side = lambda name, ys: F.struct(F.lit(name).alias("side"), ys.alias("years"))
    sides = F.array(
        side("focal", F.array(f)),
        side("back", years(f - w1, f - w0)),
        side("forward", years(f + w0, f + w1)),
    )
    return (
        focal.select("window", "focal_year", F.explode(sides).alias("s"))
        .select("window", "focal_year", "s.side", F.explode("s.years").alias("year"))
    )


def split_focal(window_docs: DataFrame, reach: int | tuple[int, int] | None = None) -> DataFrame:
    """B-3: the documents of each window labelled focal, back or forward."""
    return window_docs.join(frames(focal_years(window_docs, reach)), ["window", "year"])


def plot_label(window: Column) -> Column:
    """B-6 with its fallback: the year as text, or the name itself when it is not numeric."""
    return F.coalesce(plot_year(window).cast("string"), window)


def plot_year(window: Column) -> Column:
    """B-6: a window name as a year; the mean of the halves of ``a-b``, NULL when not numeric."""
    parts = F.split(window, "-")
    halves = (F.get(parts, 0).try_cast("double") + F.get(parts, 1).try_cast("double")) / 2.0
    return F.coalesce(window.try_cast("double"), F.when(F.size(parts) == 2, halves))
