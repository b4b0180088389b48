"""Splitting text into the pieces that byte-level merges work on, and remembering results by piece."""

from __future__ import annotations

import base64
import ctypes
import gc

import pyarrow as pa
import regex

# Unicode's White_Space class. The standard library counts a few control characters more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str):
    """The function that lists the matches of a published pattern, with its white space spelled out."""
    pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(pattern).findall


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Memo(dict):
    """Results by short text, in two generations: when the younger is full it becomes the older, and the older is
    forgotten. What is used again moves to the younger. So the size is bounded and frequent keys stay."""

    def __init__(self, function, entries: int = 300_000, longest: int = 64):
        super().__init__()
        self.function, self.entries, self.longest, self.older = function, entries, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_resident: dict = {}


def release() -> None:
    """Forgets what this process keeps and hands the memory back, so that it does not add to that of other work."""
    if _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)


def resident(key, make):
    """The object of a key that this process keeps between its tasks; it forgets the one of any other key."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]
