"""Token ids in patched frame-of-reference blocks.

A document's ids are cut into blocks of BLOCK. Of each block the minimum is subtracted, the rest is packed at the width
that PERCENTILE of its values need, and values that need more are stored whole in an exception list. The start of every block is indexed, so
any block can be read without those before it.

A block is: minimum (uint32), width (uint8), ids (uint8), exceptions (uint8), then the packed values, the
low order bits first, padded to a byte, then the exceptions' places (uint8 each) and values less minimum (uint32 each).

Ids are those of a public byte-level vocabulary, a file of ranks that every worker can read. Defined results: a null text has null
payload and index and 0 ids; an empty text has an empty payload; repeated rows are each encoded; very long texts are
encoded in pieces that begin at a single space between two words, which gives the ids of the whole text; of equal values at the percentile all are packed; an empty table gives an
empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, PERCENTILE = 128, 90
#: How texts are cut before merging, for public byte-level vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters beyond which a text is encoded in pieces.
PIECE = 200_000
_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("n", "u1"), ("exceptions", "u1")])


@lru_cache(maxsize=4)
def _encoding(vocabulary: str, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(vocabulary).name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SPACE = re.compile(r"(?<=[^\s]) (?=[^\s])")


def text_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size`; each but the first starts with a single space between two words, where a token can't reach across."""
    begin = 0
    while len(text) - begin > size:
        cut = _SPACE.search(text, begin + size)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def token_ids(texts: list[str], vocabulary: str, pattern: str = PATTERN) -> list[np.ndarray]:
    encode = _encoding(vocabulary, pattern).encode_ordinary
    return [np.array(encode(t) if len(t) <= PIECE else [i for p in text_pieces(t) for i in encode(p)], dtype=np.uint32) for t in texts]


def encode(streams: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> list[tuple[bytes, np.ndarray, int]]:
    """(payload, start of each block in it, number of exceptions) of each stream of ids."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    blocks = -(-lengths // block)
    total = int(blocks.sum())
    if not total:
        return [(b"", np.zeros(0, dtype=np.int32), 0) for _ in streams]
    n = np.full(total, block, dtype=np.int64)
    last = np.cumsum(blocks) - 1
    some = lengths > 0
    n[last[some]] = (lengths - (blocks - 1) * block)[some]
    place = np.arange(block)
    inside = place < n[:, None]
    values = np.zeros((total, block), dtype=np.uint32)
    values[inside] = np.concatenate(streams)
    least = np.where(inside, values, np.uint32(2**32 - 1)).min(axis=1)
    values = np.where(inside, values - least[:, None], 0).astype(np.uint32)
    ordered = np.sort(np.where(inside, values, np.uint32(2**32 - 1)), axis=1)
    at = np.minimum(np.ceil(n * percentile / 100).astype(np.int64), n) - 1
    limit = ordered[np.arange(total), np.maximum(at, 0)]
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    over = inside & (values >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    exceptions = over.sum(axis=1)
    packed_size = (n * width + 7) // 8
    size = _HEAD.itemsize + packed_size + 5 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    head = np.zeros(total, dtype=_HEAD)
    head["least"], head["width"], head["n"], head["exceptions"] = least, width, n, exceptions
    out[start[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(total, -1)
    kept = np.where(over, 0, values)
    groups = [(w, np.flatnonzero(width == w)) for w in np.unique(width[width > 0])]
    for w, own in ((w, g[i : i + 2048]) for w, g in groups for i in range(0, len(g), 2048)):  # bits take 32 times the room
        bits = np.unpackbits(kept[own].astype("<u4").view(np.uint8).reshape(len(own), block, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        column = np.arange(packed.shape[1])
        real = column < packed_size[own][:, None]
        out[(start[own] + _HEAD.itemsize)[:, None].repeat(len(column), 1)[real] + np.broadcast_to(column, real.shape)[real]] = packed[real]
    if exceptions.any():
        row, col = np.nonzero(over)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = (start + _HEAD.itemsize + packed_size)[row]
        out[base + nth] = col
        out[(base + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = values[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    ends = np.cumsum(blocks)
    result = []
    for i, end in enumerate(ends):
        own = slice(end - blocks[i], end)
        if not blocks[i]:
            result.append((b"", np.zeros(0, dtype=np.int32), 0))
            continue
        first = start[own][0]
        result.append((out[first : start[end - 1] + size[end - 1]].tobytes(), (start[own] - first).astype(np.int32), int(exceptions[own].sum())))
    return result


def decode_block(payload: bytes, start: int) -> np.ndarray:
    """The ids of the block that starts there."""
    least, width, n, exceptions = (int(x) for x in np.frombuffer(payload, dtype=_HEAD, count=1, offset=start)[0])
    at = start + _HEAD.itemsize
    size = (n * width + 7) // 8
    out = np.zeros(n, dtype=np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8, count=size, offset=at), bitorder="little")[: n * width].reshape(n, width)
        padded = np.zeros((n, 32), dtype=np.uint8)
        padded[:, :width] = bits
        out = np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)
    if exceptions:
        places = np.frombuffer(payload, dtype=np.uint8, count=exceptions, offset=at + size)
        out[places] = np.frombuffer(payload, dtype="<u4", count=exceptions, offset=at + size + exceptions)
    return out + np.uint32(least)


def decode(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of a payload."""
    return np.concatenate([decode_block(payload, int(s)) for s in starts]) if len(starts) else np.zeros(0, dtype=np.uint32)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """(id_col, n_tokens, n_exceptions, block_starts, payload) of each row."""

    @F.pandas_udf("struct<n_tokens: bigint, n_exceptions: bigint, block_starts: array<int>, payload: binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            values = texts.tolist()
            for begin in range(0, len(values), 256):
                part = values[begin : begin + 256]
                ids = token_ids([t or "" for t in part], vocabulary, pattern)
                for t, own, (payload, starts, over) in zip(part, ids, encode(ids, block, percentile), strict=True):
                    rows.append((0, 0, None, None) if t is None else (len(own), over, starts, payload))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_exceptions", "block_starts", "payload"])

    made = docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("x"))
    return made.select(F.col("id").alias(id_col), "x.*")


def decode_texts(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, token_ids) of rows made by encode_texts()."""

    @F.pandas_udf("array<int>")
    def run(payload: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else decode(p, s).astype(np.int32) for p, s in zip(payload, starts, strict=True)])

    return encoded.select(id_col, run("payload", "block_starts").alias("token_ids"))
