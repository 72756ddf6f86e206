"""Word and shingle hashes of many texts at once, in numpy, without a Python step per word.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text; of scripts that put no space between words (Chinese, Japanese, Thai, Lao, Khmer), each character is a word, and
their punctuation, as that of full width, parts words. The hashes depend on the words alone, never on batch, segment or partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that are worked on at a time; a longer text is taken in segments.
PIECE_CHARS = 1_000_000
_GAP = re.compile(r"[ \t\n\r]")

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_BYTE[~_IS_WORD] = 0
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers; equal in, equal out."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(texts: Sequence[str | None], most: int | None = None) -> Iterator[slice]:
    """Slices of the texts that hold at most `most` characters, or one text."""
    most = most or PIECE_CHARS
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def segments(text: str, most: int | None = None) -> Iterator[str]:
    """The text in segments of at least `most` characters, each of which but the first begins at white space; no word is cut, however long."""
    most = most or PIECE_CHARS
    begin = 0
    while len(text) - begin > most and (gap := _GAP.search(text, begin + most)):
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of characters that are words by themselves, bytes of punctuation that isn't ASCII)."""
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xEF))  # all of three bytes
    lead, second, third = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    marks = (lead == 0xE3) & (second == 0x80) & (third != 0x85) & (third != 0x86) & (third != 0x87)
    # From FF00 to FFEF, all but the letters and digits of full width and half-width kana.
    wide = (lead == 0xEF) & ((second == 0xBC) & ((third <= 0x8F) | (third >= 0x9A) & (third <= 0xA0) | (third >= 0xBB)) | (second == 0xBD) & (third >= 0x9B) & (third <= 0xA5))
    gaps = at[marks | wide]
    kana = (lead == 0xEF) & ((second == 0xBD) & (third >= 0xA6) | (second == 0xBE))
    alone = (lead >= 0xE3) & (lead <= 0xE9) & ~marks | kana | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & (second >= 0x9E) & (second <= 0x9F)
    rare = np.flatnonzero((data == 0xF0) & (np.append(data[1:], 0) >= 0xA0) & (np.append(data[1:], 0) <= 0xB3))  # further ideographs
    return np.concatenate([at[alone], rare]), gaps


def scan(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each word starts, where it ends, offsets): the words of text i are offsets[i]:offsets[i + 1]."""
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower() + "\0"
    data = np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8)
    is_word = _IS_WORD[data]
    if (data >= 0xE0).any():
        alone, gaps = _unspaced(data)
        if len(gaps):
            data = data.copy()
            for j in range(3):
                data[gaps + j] = 32
                is_word[gaps + j] = False
        change = np.diff(is_word.view(np.int8), prepend=np.int8(0))
        if len(alone):
            size = np.where(data[alone] == 0xF0, 4, 3)
            first = is_word.copy()
            first[1:] &= ~is_word[:-1]
            first[alone] = True
            after = alone + size
            first[after] |= is_word[after]
            starts = np.flatnonzero(first)
            last = np.append(starts[1:], len(data))
            # A word ends where the next begins, or at the first byte that is of none.
            stops = np.flatnonzero(change == -1)
            ends = np.minimum(last, stops[np.searchsorted(stops, starts, side="right")])
            offsets = np.zeros(len(texts) + 1, dtype=np.int64)
            offsets[1:] = np.searchsorted(starts, np.flatnonzero(data == 0))
            return data, starts, ends, offsets
    else:
        change = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    offsets[1:] = np.searchsorted(starts, np.flatnonzero(data == 0))
    return data, starts, ends, offsets


def _powers(at: np.ndarray) -> np.ndarray:
    """The multiplier of a byte at each place of its word."""
    out = _POWER[at & 4095]
    if len(at) and (high := int(at.max()) >> 12):
        step = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(high, pow(_BASE, 4096, 2**64), dtype=np.uint64)]))
        out = out * step[at >> 12]
    return out


def hash_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each word that scan() found. Bytes take many times their room in between, so it goes by pieces, within a word that is longer than one."""
    parts = []
    edges = np.append(starts, len(data))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + PIECE_CHARS, side="right")) - 1)
        own, begin = edges[first : last + 1], edges[first]
        if own[-1] - begin > PIECE_CHARS:  # one word
            total = np.zeros(1, dtype=np.uint64)
            for i in range(int(begin), int(own[-1]), PIECE_CHARS):
                piece = data[i : min(i + PIECE_CHARS, int(own[-1]))]
                total += (_BYTE[piece] * _powers(np.arange(i - begin, i - begin + len(piece)))).sum(dtype=np.uint64)
            parts.append(mix(total))
        else:
            piece = data[begin : own[-1]]
            at = np.arange(len(piece), dtype=np.int32) - np.repeat((own[:-1] - begin).astype(np.int32), np.diff(own))
            values = _BYTE[piece]
            values *= _powers(at)
            parts.append(mix(np.add.reduceat(values, own[:-1] - begin)))
        first = last
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets)."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > PIECE_CHARS:
        parts = [hash_words(*scan([t])[:2]) for t in segments(texts[0])]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    data, starts, _, offsets = scan(texts)
    return hash_words(data, starts), offsets


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and offsets. A text of fewer than k words, but not of none, has one shingle: all its words."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], count)
    if n.size and n.min() >= k:
        value = sum((words[at + j] * _COEF[j] for j in range(1, k)), words[at] * _COEF[0])
    else:
        end = np.repeat(offsets[1:], count)
        padded = np.append(words, np.zeros(k, dtype=np.uint64))
        value = words[at] * _COEF[0] if len(at) else np.zeros(0, dtype=np.uint64)
        for j in range(1, k):
            value = value + np.where(at + j < end, padded[at + j], np.uint64(0)) * _COEF[j]
    return mix(value), out
