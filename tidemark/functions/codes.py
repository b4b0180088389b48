"""Classification-code scalars: level splitting and the first-mismatch similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The number of levels of a code and the base of the level weights.
LEVELS = 6
BASE = 2.0 / 3.0
CODE_PATTERN = r"^([A-Z])(\d)(\d)([A-Z])(\d+)/(\d+)"


def level_similarity(k: int, base: float = BASE) -> float:
    """S-10: similarity of two codes whose first ``k`` levels agree."""
    return 1.0 if k == LEVELS else 1.0 - base**k


def text_levels(code: Column) -> Column:
    """Six text levels: four leading characters, text left of the slash, text right of it."""
    tail = F.split(F.substring(code, 5, 1 << 30), "/")
    return F.array(*[F.substring(code, i, 1) for i in range(1, 5)], F.get(tail, 0), F.get(tail, 1))


def int_levels(code: Column) -> Column:
    """S-9: six integer levels (leading zeros vanish); NULL when the code does not match."""
    part = lambda i: F.regexp_extract(code, CODE_PATTERN, i)
    ints = [F.ascii(part(1)), part(2), part(3), F.ascii(part(4)), part(5), part(6)]
    return F.when(code.rlike(CODE_PATTERN), F.array(*[i.cast("long") for i in ints]))


def code_similarity(a: Column, b: Column, base: float = BASE) -> Column:
    """S-8: 1 - base^i at the first differing level i, 1 when all levels agree.

    Tested level by level: most codes differ in the first.
    """
    level = lambda c, i: F.get(c, i)
    out = F.when(level(a, 0) != level(b, 0), F.lit(level_similarity(0, base)))
    for i in range(1, LEVELS):
        out = out.when(level(a, i) != level(b, i), F.lit(level_similarity(i, base)))
    return out.otherwise(F.lit(1.0))


def prefixes(levels: Column) -> Column:
    """The six prefixes of a code, each closed by a bar so that ancestry is ``startswith``."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(LEVELS)),
        lambda k: F.concat(F.array_join(F.slice(levels, F.lit(1), k), "|"), F.lit("|")),
    )
