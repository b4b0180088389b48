"""Vector and weight scalars."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

EPSILON = 1e-12  # fixed value: smoothing of the impact ratio


def dot(a: Column, b: Column) -> Column:
    """S-1: dot product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v: Column) -> Column:
    """S-2: unit vector; a zero vector stays zero."""
    length = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    # array_repeat evaluates the norm once per row instead of once per element
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)


def unit_similarity(cosine: Column) -> Column:
    """S-3: cosine mapped from [-1, 1] to [0, 1]."""
    return (cosine + 1.0) / 2.0


def smoothed_ratio(forward: Column, back: Column) -> Column:
    """S-4."""
    return forward / (back + EPSILON)


def inverse_weight(total: Column) -> Column:
    """S-5: weight of a term by its inverse total frequency."""
    return 1.0 / total


def logistic_weight(total: Column, max_total: Column) -> Column:
    """S-6: logistic weight around half of the largest total frequency."""
    x = -0.5 * (total - max_total / 2.0)
    return 1.0 - 1.0 / (1.0 + F.exp(F.least(x, F.lit(700.0))))


def rare_token_weight(df: Column, n_docs: Column) -> Column:
    """S-7: 1 / (1 + 1000 p); a token that was never counted weighs 1."""
    return F.coalesce(1.0 / (1.0 + 1000.0 * df / n_docs), F.lit(1.0))


def hash60(*parts: Column, seed: int) -> Column:
    """A seeded 60-bit hash that any SQL engine with md5 can reproduce."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


# --- sums that do not depend on the order of their terms --------------------------------------------

WHOLE, REST = float(1 << 20), float(1 << 42)


def exact_parts(value: Column) -> tuple[Column, Column]:
    """A double as two longs, in units of 2^-20 and 2^-62: sums of longs are the same in any order.

    What lies below 2^-62 is cut off. Sums stay in range up to 2^43 and two million terms.
    """
    whole = F.floor(value * WHOLE)
    return whole.cast("long"), F.floor((value * WHOLE - whole) * REST).cast("long")


def from_parts(whole: Column, rest: Column) -> Column:
    return whole / WHOLE + rest / (WHOLE * REST)


def exact_sum(value: Column, over: WindowSpec | None = None) -> Column:
    """The sum of a group, or of a window, that two runs agree on to the last bit."""
    sums = [F.sum(part) for part in exact_parts(value)]
    return from_parts(*([s.over(over) for s in sums] if over is not None else sums))
