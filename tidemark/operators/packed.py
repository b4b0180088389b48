"""Rows of documents with their terms, packed for the way between tasks.

A task gathers the rows that go to the same place and sends them as one value. The terms of a package are one sorted list, which
its documents name by number, and numbers take as many bytes as they need, so a term of a document takes a few bytes and not a
string of its own. What is unpacked is what was packed, to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FULL = 1 << 21  # fixed value: entries that a task gathers before it sends them on


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _named(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different terms, sorted, and the number of each term among them."""
    named = pc.dictionary_encode(terms, null_encoding="encode")
    order = pc.sort_indices(named.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return named.dictionary.take(pa.array(order)), rank[named.indices.to_numpy(zero_copy_only=False)]


class Rows:
    """Rows of scalars ``own``, each with entries: a number in the list ``names`` of terms, and further numbers by field."""

    def __init__(self, own: pa.RecordBatch, lens: np.ndarray, names: pa.Array, codes: np.ndarray, fields: dict[str, np.ndarray]):
        self.own, self.lens, self.names, self.codes, self.fields = own, lens, names, codes, fields

    def __len__(self) -> int:
        return len(self.lens)

    @classmethod
    def of(cls, rows: pa.RecordBatch, entries: str) -> "Rows":
        """Rows whose list ``entries`` has structs with a field ``term``."""
        lists = rows.column(entries)
        flat = lists.flatten()
        names, codes = _named(flat.field("term"))
        fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type if f.name != "term"}
        lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = rows.select([c for c in rows.schema.names if c != entries])
        return cls(own, lens, names, codes, fields)

    @classmethod
    def concat(cls, parts: list["Rows"]) -> "Rows":
        if len(parts) == 1:
            return parts[0]
        names, place = _named(pa.concat_arrays([p.names for p in parts]))
        ends = np.cumsum([len(p.names) for p in parts])
        codes = np.concatenate([place[end - len(p.names) : end][p.codes] for p, end in zip(parts, ends)])
        own = pa.concat_batches([p.own for p in parts])
        fields = {f: np.concatenate([p.fields[f] for p in parts]) for f in parts[0].fields}
        return cls(own, np.concatenate([p.lens for p in parts]), names, codes, fields)

    def entries(self, rows: np.ndarray) -> np.ndarray:
        """The places of the entries of rows."""
        lens = self.lens[rows]
        starts = (np.cumsum(self.lens) - self.lens)[rows]
        return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())

    def take(self, rows: np.ndarray) -> "Rows":
        at = self.entries(rows)
        codes = self.codes[at]
        if len(codes) < len(self.names) // 8:
            used, codes = np.unique(codes, return_inverse=True)
        else:
            mark = np.zeros(len(self.names), dtype=bool)
            mark[codes] = True
            used, codes = np.flatnonzero(mark), (np.cumsum(mark) - 1)[codes]
        fields = {f: x[at] for f, x in self.fields.items()}
        return Rows(self.own.take(pa.array(rows)), self.lens[rows], self.names.take(pa.array(used)), codes.astype(np.int32), fields)

    def groups(self, keys: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The rows of each value of the keys."""
        order = np.lexsort(keys)
        change = np.any([np.diff(k[order]) != 0 for k in keys], axis=0) if len(order) else np.zeros(0, dtype=bool)
        return (g for g in np.split(order, np.flatnonzero(change) + 1) if len(g))

    def pack(self) -> bytes:
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = {f"own {c}": self.own.column(c) for c in self.own.schema.names}
        columns |= {"lens": pa.array(_narrow(self.lens)), "names": self.names, "codes": pa.array(_narrow(np.diff(self.codes, prepend=np.int32(0))))}
        for f, x in self.fields.items():
            if x.dtype.kind == "f":  # bytes of the same weight together
                columns[f"real {f}"] = pa.array(np.ascontiguousarray(x.astype(np.float64).view(np.uint8).reshape(-1, 8).T).ravel())
            else:
                columns[f"whole {f}"] = pa.array(_narrow(x))
        batch = pa.RecordBatch.from_arrays([whole(c) for c in columns.values()], names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        raw = sink.getvalue()
        return raw.size.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)

    @classmethod
    def unpack(cls, package: bytes) -> "Rows":
        raw = pa.Codec("zstd").decompress(memoryview(package)[8:], int.from_bytes(package[:8], "little"))
        batch = pa.ipc.open_stream(raw).read_next_batch()
        columns = {c: batch.column(c).flatten() for c in batch.schema.names}
        number = lambda c: columns[c].to_numpy(zero_copy_only=False)
        own = {c[4:]: x for c, x in columns.items() if c.startswith("own ")}
        fields = {c[6:]: number(c).astype(np.int64) for c in columns if c.startswith("whole ")}
        for c in columns:
            if c.startswith("real "):
                fields[c[5:]] = np.ascontiguousarray(number(c).reshape(8, -1).T).view(np.float64).ravel()
        codes = np.cumsum(number("codes").astype(np.int32), dtype=np.int32)
        own = pa.RecordBatch.from_arrays(list(own.values()), names=list(own))
        return cls(own, number("lens").astype(np.int64), columns["names"], codes, fields)


def places(column: pa.Array) -> np.ndarray:
    """Numbers that tell the values of a column apart."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of equal keys, in their order; a long run may come in several slices."""
    for batch in batches:
        numbers = [places(batch.column(c)) for c in keys]
        change = np.any([np.diff(x) != 0 for x in numbers], axis=0) if len(batch) > 1 else np.zeros(0, dtype=bool)
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                yield tuple(part.column(c)[0].as_py() for c in keys), part


def send(parts: list[Rows], keys: list[str], drop: list[str] = ()) -> Iterator[pa.RecordBatch]:
    """A package for each value of ``keys``, which stay columns and leave the package, as do those in ``drop``."""
    rows = Rows.concat(parts)
    inside = [c for c in rows.own.schema.names if c not in keys and c not in drop]
    heads, packages = [], []
    for group in rows.groups([places(rows.own.column(c)) for c in keys]):
        part = rows.take(group)
        heads.append(group[0])
        part.own = part.own.select(inside)
        packages.append(part.pack())
    first = pa.array(np.array(heads, dtype=np.int64))
    columns = [rows.own.column(c).take(first) for c in keys]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(packages, pa.binary())], names=[*keys, "package"])


def packer(keys: list[str], entries: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows with a list ``entries`` to packages by ``keys``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(Rows.of(batch, entries))
            n += len(held[-1].codes)
            if n >= FULL:
                yield from send(held, keys)
                held, n = [], 0
        if held:
            yield from send(held, keys)

    return kernel
