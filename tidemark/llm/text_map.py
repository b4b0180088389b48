"""Row-wise work on texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, columns: list[str], schema: str, worker: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row per input row. ``worker()`` runs once in each task and returns the function of one row's values.

    Rows leave in pieces of a few hundred, so a task holds one batch of input and little output.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = worker()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [function(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type) for values, field in zip(zip(*rows), target)], schema=target
                )

    return df.select(*columns).mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that are bounded in rows and, unless a single row is longer, in bytes."""
    start = 0
    while start < batch.num_rows:
        size = min(rows, batch.num_rows - start)
        while size > 1 and batch.slice(start, size).nbytes > most_bytes:
            size //= 2
        yield batch.slice(start, size)
        start += size


def map_pieces(df: DataFrame, columns: list[str], schema: str, worker: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """As ``map_rows``, for a function of lists of values that returns lists of values."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = worker()
        for batch in batches:
            for part in pieces_of(batch):
                found = function(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, target)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def keep_pieces(df: DataFrame, column: str, worker: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows, with all their columns, for whose value the function, which takes a list of values, says yes."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = worker()
        for batch in batches:
            for part in pieces_of(batch):
                yield part.filter(pa.array(function(part.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def keep_rows(df: DataFrame, column: str, worker: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows, with all their columns, for whose value the function says yes. ``worker()`` runs once in each task."""

    def make():
        function = worker()
        return lambda values: [bool(function(v)) for v in values]

    return keep_pieces(df, column, make)
