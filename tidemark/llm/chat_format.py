"""Chat formatting on tokens: segments are encoded by themselves, reserved ids are spliced between them.

A turn is written as a pair of control marks around its text; the pair names the role, and roles without a
pair of their own are spelled out before their text. Marks become reserved ids above the vocabulary and are
never the result of encoding a text: a control string inside a role or text is escaped by one backslash after
its first sign (and each already escaped one by one more), which is undone when the output is read.

The loss mask is a 0/1 array over the tokens, built from the prefix sums of the segment lengths: 1 on the text
tokens of assistant turns, 0 on marks and on all other turns.

Null roles and texts are empty. Null turns stand first; rows that share a turn are ordered by role and text, and
rows that are equal in all of them are interchangeable and all kept. Rows with a null conv_id form one conversation
of that id. Columns other than the four are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.pieces import read_ranks
from tidemark.llm.text_map import map_rows

#: Opening and closing mark of a role; other roles are written as ``<|role|>role<|text|>text<|end|>``.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, SPOKEN, ENDED = "<|role|>", "<|text|>", "<|end|>"
CONTROLS = [*(m for pair in MARKS.values() for m in pair), NAMED, SPOKEN, ENDED]

_rests = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == "<")
_insts = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == "[")
CONTROL = re.compile(rf"(?:<(?=\\*(?:{_rests}))|\[(?=\\*(?:{_insts})))")
ESCAPED = re.compile(rf"(?:<(?=\\+(?:{_rests}))|\[(?=\\+(?:{_insts})))\\")

TURNS = "conv_id long, turn long, role string, text string, ids array<int>, mask array<int>, n_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0], text)


class Template:
    """Writes and reads turns under one rank file."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        first = max(ranks.values()) + 1
        self.reserved = {mark: first + i for i, mark in enumerate(CONTROLS)}
        self.marks = {number: mark for mark, number in self.reserved.items()}

    def segments(self, role: str, text: str) -> list[tuple[str, bool, int]]:
        """What a turn is made of: (string, is a control mark, is under the loss)."""
        if role in MARKS:
            before, after = MARKS[role]
            return [(before, True, 0), (text, False, int(role == "assistant")), (after, True, 0)]
        return [(NAMED, True, 0), (role, False, 0), (SPOKEN, True, 0), (text, False, 0), (ENDED, True, 0)]

    def write(self, role: str, text: str) -> tuple[list[int], list[int], int]:
        """Ids, loss mask and formatted code points of a turn."""
        parts, chars = [], 0
        pieces = self.segments(role, text)
        for string, is_mark, _ in pieces:
            string = string if is_mark else escape(string)
            chars += len(string)
            parts.append([self.reserved[string]] if is_mark else self.encoding.encode_ordinary(string))
        ids = [t for p in parts for t in p]
        ends = list(accumulate(map(len, parts)))
        mask = [0] * len(ids)
        for (_, _, loss), start, end in zip(pieces, [0, *ends], ends):
            if loss:
                mask[start:end] = [1] * (end - start)
        return ids, mask, chars

    def read(self, ids: list[int], mask: list[int]) -> tuple[str, str, str]:
        """Role, text and text under the loss of a written turn, from its ids and mask alone."""
        return self.read_sized(ids, mask)[:3]

    def read_sized(self, ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
        """As ``read``, with the turn's formatted code points, marks and escapes included."""
        at = [(i, self.marks[t]) for i, t in enumerate(ids) if t in self.marks]
        inside = [self.formatted(ids[i + 1 : j]) for (i, _), (j, _) in zip(at, at[1:])]
        opening = at[0][1]
        role = unescape(inside[0]) if opening == NAMED else next(r for r, pair in MARKS.items() if pair[0] == opening)
        chars = sum(len(mark) for _, mark in at) + sum(map(len, inside))
        return role, unescape(inside[-1]), unescape(self.formatted([t for t, m in zip(ids, mask) if m])), chars

    def formatted(self, ids: list[int]) -> str:
        """The text of ids between marks, as it stands in the output."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode()


@lru_cache(2)
def template_of(path: str, pattern: str) -> Template:
    return Template(path, pattern)


def format_turns(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per turn: its ids, loss mask and formatted length. A conversation is its turns' ids one after another."""

    def worker():
        template = template_of(path, pattern)

        def row(conv, turn, role, text):
            role, text = role or "", text or ""
            return (conv, turn, role, text, *template.write(role, text))

        return row

    return map_rows(df, ["conv_id", "turn", "role", "text"], TURNS, worker)


def place_turns(turns: DataFrame, span: int = 4096) -> DataFrame:
    """Adds ``start``, the token offset of each turn in its conversation.

    Offsets are prefix sums in two levels, over ranges of ``span`` turn numbers and inside a range, so that a very
    long conversation is not ordered in one task.
    """
    sized = turns.withColumn("_span", F.floor(F.col("turn") / span)).withColumn("_n", F.size("ids").cast("long"))
    spans = sized.groupBy("conv_id", "_span").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("conv_id").alias("_conv"), F.col("_span").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy("conv_id", "_span")
        .orderBy(F.asc_nulls_first("turn"), "role", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = sized.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_span").eqNullSafe(F.col("_of")))
    start = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return joined.withColumn("start", start).drop("_span", "_n", "_conv", "_of", "_before")


def read_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """The turns back from formatted output: role, text, text under the loss and length; nothing but ids and masks is read."""

    def worker():
        template = template_of(path, pattern)
        return lambda conv, start, ids, mask: (conv, start, *template.read_sized(ids, mask))

    return map_rows(
        turns, ["conv_id", "start", "ids", "mask"],
        "conv_id long, start long, role string, text string, loss string, n_chars long", worker,
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(read: DataFrame) -> DataFrame:
    """Digests of conversations by running hashes over their sorted turns.

    A digest needs its turns in order, so the turns of a conversation pass through one task, a batch at a time; what the
    task holds is two hash states and three numbers, however long the conversation is.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        key, state, done = None, None, []

        def close():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for conv, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield packed(done)
                done = []
        if state is not None:
            yield packed([close()])

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.select("conv_id", "role", "text", "loss", "n_chars").mapInArrow(run, DIGESTS)
