"""Token counts, encoding and chat formatting, against the public libraries and by round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe_transducer, chat_format, token_count, token_queries
from tidemark.llm.pieces import Memo, read_ranks

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SIGNS = " \n\t\r\xa0　\x1c\x85aàbß日本語1٣²_'’s.,$é😀́"
ODD = ["", " ", "a" * 3000, "we'll  don't 've", "<|endoftext|> a<|endoftext|>  b", "\n\n  \t x", "́́é"]
DOCS = "doc_id long, text string, n_tokens string, lang string"


def texts() -> list[str]:
    rng = random.Random(7)
    return ODD + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(50))) for _ in range(300)]


def rows(spark, values):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(values)] + [(None, None, None, None), (1, "twice", "", "")], DOCS)


def test_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(JSON)
    got = token_count.count_tokens(rows(spark, texts()), JSON, PATTERN, limit=20).collect()
    assert len(got) == len(texts()) + 2
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts()):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert any(r.n_tokens == n and r.n_bytes == len(text.encode()) and r.over_limit == (n > 20) for r in by_id[i]), text
    assert by_id[None][0][1:] == (0, 0, False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=SIGNS, max_size=40))
def test_transducer_encodes_as_the_library(text):
    codec = bpe_transducer.codec_of(MULTI, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


def test_a_full_state_table_starts_anew():
    small = bpe_transducer.Transducer(read_ranks(MULTI), max_states=20)
    large = bpe_transducer.codec_of(MULTI, PATTERN).transducer
    for word in ("international", " understanding", "straßenbahn", "ångström", "x" * 200):
        assert small.encode(word.encode()) == large.encode(word.encode())


@given(st.binary(max_size=30), st.integers(0, 30))
def test_streaming_decode_is_the_library_codec(data, cut):
    decoder = bpe_transducer.StreamDecoder({b: bytes((b,)) for b in range(256)})
    assert decoder.feed(list(data[:cut])) + decoder.feed(list(data[cut:])) + decoder.finish() == data.decode("utf-8", "replace")


def test_round_trip_rows(spark):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})
    df = rows(spark, texts())
    got = {r.ids_sha256: r for r in bpe_transducer.round_trip(df, MULTI, PATTERN).collect()}
    for text in [*texts(), "twice", ""]:
        ids = library.encode_ordinary(text)
        r = got[hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
    ids = bpe_transducer.encode_texts(df.where("doc_id > 1"), MULTI, PATTERN)
    back = {r.doc_id: r.text for r in bpe_transducer.decode_ids(ids, MULTI).collect()}
    assert back == {i: t for i, t in enumerate(texts()) if i > 1}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert token_count.count_tokens(empty, JSON, PATTERN).count() == 0
    assert bpe_transducer.round_trip(empty, MULTI, PATTERN).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    placed = chat_format.place_turns(chat_format.format_turns(turns, PLAIN, PATTERN))
    assert chat_format.digest_conversations(chat_format.read_turns(placed, PLAIN, PATTERN)).count() == 0


def test_memo_is_bounded():
    memo = Memo(len, 10)
    assert [memo["x" * n] for n in range(1, 60)] == list(range(1, 60)) and len(memo) <= 10 and len(memo.older) <= 10


parts = st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "<", "[", "INST]", "s>", "a", "é ", "\n"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(parts, st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]))
def test_turns_are_read_back(text, role):
    template = chat_format.template_of(PLAIN, PATTERN)
    ids, mask, chars = template.write(role, text)
    assert template.read(ids, mask) == (role, text, text if role == "assistant" else "")
    escaped = chat_format.escape(text)
    assert not any(c in escaped for c in chat_format.CONTROLS) and chat_format.unescape(escaped) == text
    assert len(mask) == len(ids) and chars >= len(role if role not in chat_format.MARKS else "") + len(text)


def test_conversations(spark):
    data = [
        (1, 2, "assistant", "b </s> \\"), (1, 1, "user", None), (1, 9000, "tool", "[INST]"), (1, None, None, "first"), (2, 1, "user", "x"),
        (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (None, 1, "assistant", "z"),
    ]
    df = spark.createDataFrame([(*d, "extra") for d in data], "conv_id long, turn long, role string, text string, ids string")
    turns = chat_format.place_turns(chat_format.format_turns(df, PLAIN, PATTERN))
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.read_turns(turns, PLAIN, PATTERN)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in data if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    starts = [r.start for r in turns.where("conv_id = 1").orderBy("start").collect()]
    sizes = [len(r.ids) for r in turns.where("conv_id = 1").orderBy("start").collect()]
    assert starts == [sum(sizes[:i]) for i in range(len(sizes))]


@pytest.mark.parametrize("name", ["op4_token_counts", "op7_bpe_round_trip"])
def test_queries_cover_all_documents(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in getattr(token_queries, name)(spark, sf).collect()}
    if name.startswith("op4"):
        library = Tokenizer.from_file(JSON)
        want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    else:
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})
        want = {r.doc_id: len(library.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert got == want


def test_formatted_length_is_read_from_the_output():
    template = chat_format.template_of(PLAIN, PATTERN)
    for role, text in [("user", "a [/INST] b"), ("assistant", ""), ("tool <|text|>", "x </s>\n<s\\>"), ("system", "日本 <<SYS>>")]:
        ids, mask, chars = template.write(role, text)
        assert template.read_sized(ids, mask) == (role, text, text if role == "assistant" else "", chars)
        assert template.read_sized(ids[:1] + ids[-1:], [0, 0])[3] < chars or not text
