"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. Tokens that follow each other in an encoding are exactly those pairs whose joined bytes
encode to the pair again, and every prefix of a piece has one encoding. So after each byte, one
hypothesis is kept for every earlier position from which some token could still be growing: the bytes
since that position, the last token before it, and the tokens not yet emitted. The set of hypotheses is
a state. Tokens that all hypotheses share are emitted at once, which is after a lookahead of at most
the longest token. States and transitions are made when they are first needed and thrown away together
when there are too many, as a lazy automaton does.

Decoding. A token's bytes run through a UTF-8 state machine that holds back an unfinished character;
its steps are remembered by (held-back bytes, token).

Nulls are encoded as empty texts (no ids). Ids of rows may repeat or be null; each row is encoded by
itself. Columns other than the two named are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import DataFrame

from tidemark.llm.pieces import read_ranks, resident, splitter, Memo
from tidemark.llm.text_map import map_rows

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
START = -1


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The defining procedure on a short string: merge the pair of lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes pieces; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 250_000):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.growing: dict[bytes, bytes] = {}  # every beginning of a token, each held once
        for token in ranks:
            for k in range(1, len(token)):
                self.growing.setdefault(token[:k], token[:k])
        self.together: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the first. A state is one flat tuple, three items a hypothesis; a step's key is state and byte."""
        first = (b"", START, ())
        self.states, self.numbers, self.steps, self.pendings = [first], {first: 0}, {}, {(): ()}
        if len(self.together) > 2 * self.max_states:
            self.together.clear()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a byte, and (-1, -1) if its bytes encode to something else."""
        if token not in self.made_of:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                pairs = [(self.ranks.get(a + b, len(self.ranks) + 256), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(pairs)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            pair = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None if len(parts) == 1 else (-1, -1)
            self.made_of[token] = pair
        return self.made_of[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the pair (or, at the start, the token alone) is its own encoding.

        Merges run by rank, so what touches the border between the two tokens is followed backwards: at every time the
        pair across it must not merge before one of its sides grows. ``until`` is the rank at which that happens; of
        equal ranks the left one comes first.
        """
        if self.halves(right) == (-1, -1):
            return False
        if left == START:
            return True
        pair = left << 32 | right
        known = self.together.get(pair)
        if known is not None:
            return known
        a, b, until, first = left, right, len(self.ranks) + 256, True
        while True:
            rank = self.ranks.get(self.tokens[a] + self.tokens[b])
            if rank is not None and (rank < until or rank == until and first):
                known = False
                break
            grown_a, grown_b = self.halves(a), self.halves(b)
            if grown_a is None and grown_b is None:
                known = True
                break
            if grown_b is None or grown_a is not None and a > b:
                until, first, a = a, False, grown_a[1]  # the merge inside the left token stands left of the border
            else:
                until, first, b = b, True, grown_b[0]
        self.together[pair] = known
        return known

    def step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition by a byte, made now: the next state and the tokens that are certain."""
        found, alive, state, more = None, [], self.states[number], bytes((byte,))
        for i in range(0, len(state), 3):
            since, last, pending = state[i] + more, state[i + 1], state[i + 2]
            token = self.ranks.get(since)
            if found is None and token is not None and self.may_follow(last, token):
                found = (b"", token, (*pending, token))
            since = self.growing.get(since)
            if since is not None:
                alive.append((since, last, pending))
        alive.append(found)
        sure = 0
        shortest = min(len(p) for _, _, p in alive)
        while sure < shortest and len({p[sure] for _, _, p in alive}) == 1:
            sure += 1
        out = alive[0][2][:sure]
        held = self.pendings.setdefault
        key = tuple(x for since, last, pending in alive for x in (since, last, held(pending[sure:], pending[sure:])))
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.states)
            self.states.append(key)
        self.steps[number << 8 | byte] = to, out
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        ids, number, known = [], 0, self.steps.get
        for byte in piece:
            number, out = known(number << 8 | byte) or self.step(number, byte)
            ids += out
        return ids + list(self.states[number][-1])


def utf8_step(held: bytes, more: bytes) -> tuple[str, bytes]:
    """The characters completed by ``more`` and the unfinished rest (three bytes at most); bytes that cannot start or go on become U+FFFD."""
    text, need, data, start, i = [], 0, held + more, 0, 0
    while i < len(data):
        lead = data[i]
        need = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if need == 0:
            text.append("�")
            i += 1
        else:
            end = i + 1
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            while end < len(data) and end - i < need and low <= data[end] <= high:
                end, low, high = end + 1, 0x80, 0xBF
            if end - i == need:
                text.append(data[i:end].decode())
            elif end == len(data):
                return "".join(text), data[i:]
            else:
                text.append("�")
            i = end
        start = i
    return "".join(text), data[start:]


class StreamDecoder:
    """Turns ids into text as they arrive; ``finish`` tells of a character that was never completed."""

    def __init__(self, tokens: dict[int, bytes], entries: int = 200_000):
        self.tokens, self.entries, self.held = tokens, entries, b""
        self.forget()

    def forget(self) -> None:
        """Steps of a state by token: the characters, the bytes then held back, and the steps of that state."""
        self.known, self.states = 0, {b"": {}}

    def step(self, held: bytes, token: int) -> tuple[str, bytes, dict]:
        if self.known >= self.entries:
            self.forget()
        text, rest = utf8_step(held, self.tokens[token])
        step = text, rest, self.states.setdefault(rest, {})
        self.states.setdefault(held, {})[token] = step
        self.known += 1
        return step

    def feed(self, ids: list[int]) -> str:
        text, held = [], self.held
        steps = self.states.setdefault(held, {})
        for token in ids:
            piece, held, steps = steps.get(token) or self.step(held, token)
            text.append(piece)
        self.held = held
        return "".join(text)

    def finish(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""


class Codec:
    """Texts to ids and back under one rank file."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.pieces = splitter(pattern)
        self.decoder = StreamDecoder(self.transducer.tokens)
        self.of_piece = Memo(lambda piece: tuple(self.transducer.encode(piece.encode())), 150_000)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.of_piece.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.finish()


def codec_of(path: str, pattern: str) -> Codec:
    """One codec in a process: tasks that follow each other use its states, until other work keeps something else."""
    return resident(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of ids of every text."""

    def worker():
        codec = codec_of(path, pattern)
        return lambda key, text: (key, codec.encode(text or ""))

    return map_rows(df, [id_col, text_col], "doc_id long, ids array<int>", worker)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every array of ids; null arrays give empty texts."""

    def worker():
        decoder = StreamDecoder({rank: token for token, rank in read_ranks(path).items()})
        return lambda key, ids: (key, decoder.feed(ids or []) + decoder.finish())

    return map_rows(df, [id_col, ids_col], "doc_id long, text string", worker)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass; digests of the ids (decimals joined by commas) and of the decoded bytes."""

    def worker():
        codec = codec_of(path, pattern)
        decimal = {t: str(t) for t in codec.transducer.tokens}.__getitem__

        def row(key, text):
            ids = codec.encode(text or "")
            written = hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest()
            return key, len(ids), written, hashlib.sha256(codec.decode(ids).encode()).hexdigest()

        return row

    return map_rows(df, [id_col, text_col], SCHEMA, worker)
