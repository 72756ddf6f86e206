from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm import token_blocks as tb
from corpuskit.llm.queries import VOCABULARY

ids = st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=400)


@settings(max_examples=150, deadline=None)
@given(st.lists(ids, max_size=5), st.sampled_from([1, 50, 90, 100]))
def test_round_trip_is_exact(streams, percentile):
    streams = [np.array(s, dtype=np.uint32) for s in streams]
    for s, (payload, starts, over) in zip(streams, tb.encode(streams, 128, percentile), strict=True):
        assert (tb.decode(payload, starts) == s).all() and len(starts) == -(-len(s) // 128)
        if percentile == 100:
            assert over == 0


def test_width_is_the_percentile_and_outliers_are_exceptions():
    s = np.array([1000 + i % 8 for i in range(126)] + [50_000, 49_000], dtype=np.uint32)
    ((payload, starts, over),) = tb.encode([s], 128, 90)
    assert over == 2 and payload[4] == 3 and len(payload) == 7 + 128 * 3 // 8 + 2 * 5
    assert (tb.decode_block(payload, 0) == s).all()


def test_any_block_can_be_read_by_its_start():
    s = np.random.default_rng(1).integers(0, 50_000, 1000).astype(np.uint32)
    ((payload, starts, _),) = tb.encode([s])
    assert (tb.decode_block(payload, starts[5]) == s[640:768]).all()


def test_pieces_of_long_texts_encode_like_the_whole():
    text = "Some words, and more\n\nlines  of them. " * 400
    pieces = list(tb.text_pieces(text, 500))
    assert "".join(pieces) == text and len(pieces) > 10
    whole = tb._encoding(VOCABULARY).encode_ordinary(text)
    assert [i for p in pieces for i in tb._encoding(VOCABULARY).encode_ordinary(p)] == whole


def test_texts_come_back(spark):
    texts = ["hello world", "", None, "naïve ünïcödé 🙂 " * 300, "hello world", "a" * 5000]
    df = spark.createDataFrame([(i, t, 1, b"") for i, t in enumerate(texts)] + [(None, "x", 1, b"")], "doc_id bigint, text string, n_tokens int, payload binary")
    encoded = tb.encode_texts(df, VOCABULARY)
    got = {r.doc_id: r.token_ids for r in tb.decode_texts(encoded).collect()}
    enc = tb._encoding(VOCABULARY)
    for i, t in enumerate(texts):
        assert got[i] is None if t is None else enc.decode(got[i]) == t
    assert {r.doc_id: r.n_tokens for r in encoded.collect()}[1] == 0
    assert tb.encode_texts(df.limit(0), VOCABULARY).count() == 0


def plain_decode(payload):
    """The ids of a payload, bit by bit, from the layout that the module's docstring gives."""
    out, at = [], 0
    while at < len(payload):
        least, width, n, exceptions = int.from_bytes(payload[at : at + 4], "little"), *payload[at + 4 : at + 7]
        packed = int.from_bytes(payload[at + 7 : at + 7 + (n * width + 7) // 8], "little")
        own = [packed >> i * width & (1 << width) - 1 for i in range(n)]
        at += 7 + (n * width + 7) // 8
        for j in range(exceptions):
            own[payload[at + j]] = int.from_bytes(payload[at + exceptions + 4 * j : at + exceptions + 4 * j + 4], "little")
        at += 5 * exceptions
        out += [least + x for x in own]
    return out


@settings(max_examples=100, deadline=None)
@given(ids, st.sampled_from([50, 90, 100]))
def test_the_layout_is_the_documented_one(stream, percentile):
    ((payload, _, _),) = tb.encode([np.array(stream, dtype=np.uint32)], 128, percentile)
    assert plain_decode(payload) == stream
