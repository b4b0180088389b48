"""Text rules as column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Character classes that agree with the usual Unicode meaning of "word character",
# "white space" and "upper case" in the cleaning rules.
WORD = r"[\p{L}\p{N}_]"
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same characters for Java, which finds single ones below U+0100 in one table: all others pass a single range.
SPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
UPPER = r"\p{IsUppercase}"
SINGLE_LETTER_WORDS = ("a", "i")


SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if re.match(f"[{SPACES}]", chr(c)))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """H-11: each run of white space becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def split_words(text: Column) -> Column:
    """White-space tokens, without empty strings."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def remove_unprintable(text: Column) -> Column:
    """H-1: delete U+0080 to U+FFFF."""
    return F.regexp_replace(text, r"[\u0080-\uffff]+", "")


def remove_remains(text: Column) -> Column:
    """H-5: delete punctuation that touches no word, then squeeze spaces."""
    mark = rf"[^\p{{L}}\p{{N}}_{SPACES}]"
    # the look-behind follows the first mark, so that letters and spaces are passed over quickly
    loose = F.regexp_replace(text, rf"(?s){mark}(?<!{WORD}.){mark}*(?!{WORD})", "")
    return strip(F.regexp_replace(loose, "  +", " "))


def clean_words(text: Column, keep_caps: bool = False, remove_non_alpha: bool = False) -> Column:
    """H-4: blank out bad words (single letters, one-letter runs, triples), lower-case the rest."""
    out = text if keep_caps else F.lower(text)
    start, end = f"(?<!{WORD})", f"(?!{WORD})"
    if remove_non_alpha:
        out = F.regexp_replace(out, rf"{start}\p{{L}}*+[\p{{N}}_]{WORD}*", "")
    singles = "".join(SINGLE_LETTER_WORDS)
    single = rf"(?![{singles}]{end}){WORD}"
    return F.regexp_replace(
        out, rf"(?i){start}(?:{single}|([a-z])\1+|{WORD}*?([a-z])\2\2{WORD}*){end}", ""
    )


def survives_cleaning(token: Column, remove_non_alpha: bool = False) -> Column:
    """Whether H-4 would keep a white-space token when it is tested as a whole."""
    singles = "".join(SINGLE_LETTER_WORDS)
    keep = ((F.length(token) >= 2) | token.rlike(f"(?i)^[{singles}]$")) & ~token.rlike(
        rf"(?i)([a-z])\1(?:\1|(?<!{WORD}..)(?!{WORD}))"
    )
    return keep & token.rlike(r"^\p{L}+$") if remove_non_alpha else keep


def split_and_clean(text: Column, remove_non_alpha: bool = False) -> Column:
    """H-10: white-space tokens that survive H-4."""
    tokens = F.split(text, f"[{SPACES}]+")
    return F.filter(tokens, lambda w: survives_cleaning(w, remove_non_alpha))


def count_upper(text: Column) -> Column:
    """H-8: number of upper-case letters."""
    return F.length(F.regexp_replace(text, f"[^{UPPER}]", ""))


def chunk(words: Column, size: int) -> Column:
    """H-9: consecutive slices of at most ``size`` elements."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(size)))
    return F.coalesce(
        F.transform(starts, lambda s: F.slice(words, s, size)),
        F.array().cast("array<array<string>>"),
    )


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}{WORD}+)"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    return F.coalesce(
        F.transform(starts, lambda s: F.array_join(F.slice(tokens, s, n), " ")),
        F.array().cast("array<string>"),
    )


def counted(terms: Column) -> Column:
    """Each distinct term of an array with its count, as an array of (term, tf): runs of the sorted terms."""
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluates ``value`` once

    def runs(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
        places = places.when(F.size(words) == 0, F.array().cast("array<int>"))  # no terms, which is not an unknown text
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(words))
        return bound(starts, lambda s: F.transform(
            s, lambda i, k: F.struct(F.get(words, i).alias("term"), (end(s, k) - i).cast("long").alias("tf"))
        ))

    return bound(F.sort_array(terms), runs)
