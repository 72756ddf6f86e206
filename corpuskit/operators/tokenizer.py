"""A byte-level BPE vocabulary with special and locked words: training, encoding, decoding, and scope markers for code.

Counting pre-tokens is a distributed aggregate in the JVM; merges are learned on the table of distinct ones, on the driver under a bound.
Encoding runs once for each distinct pre-token of an Arrow batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re as stdlib_re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import Words

EOS, INDENT, DEDENT = Words().special[:3]
#: A run of white space before a word leaves its last character to the word, or alone if that isn't a blank.
_PLAIN = r"'(?:[sdmt]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{N}\p{L}]+)|\s+(?!\S)|\s"
_FENCED = regex.compile(r"`{3}[-+_0-9A-Za-z]*\s*(.*?)\s*`{3}", regex.DOTALL)
_MIDDLE = regex.compile(r"<\|fim_(?:suffix|prefix|middle)\|>")
#: Distinct pre-tokens that the driver takes at most.
MOST_WORDS = 20_000_000
#: Pre-tokens whose ids a vocabulary keeps at hand at most, the streams that are decoded at a time, and the bytes of text that are encoded at a time.
KEPT_WORDS, AT_A_TIME, BYTES_AT_A_TIME = 100_000, 256, 2_000_000


def _printable() -> dict[int, str]:
    """A printable character for every byte; those that have one of their own keep it."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


BYTE_CHAR = _printable()
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}
_NO_RANK = 1 << 60


def byte_chars(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(BYTE_CHAR)


def split_pattern(locked: Iterable[str] = ()) -> str:
    """How text is cut into pre-tokens, without regard to case; locked words come first unless a word character follows."""
    words = [regex.escape(w) for w in locked]
    return (f" ?(?:{'|'.join(words)})(?![0-9A-Z_a-z])|" if words else "") + _PLAIN


def java_pattern(locked: Iterable[str] = ()) -> str:
    r"""The same for the JVM; \s, case and letters by Unicode, which Java doesn't do by itself."""
    words = [stdlib_re.sub(r"([^0-9A-Za-z])", r"\\\1", w) if w != "\n" else r"\n" for w in locked]
    return "(?iuU)" + (f" ?(?:{'|'.join(words)})(?![0-9A-Z_a-z])|" if words else "") + _PLAIN


class _Known(dict):
    """What has been found for the keys asked for, forgotten when it is too much."""

    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.find(key)
        return found


@dataclass
class Vocabulary:
    """Ids of tokens, ranks of merges, and the words that are never cut."""

    ids: dict[str, int] = field(default_factory=lambda: {BYTE_CHAR[b]: b for b in range(256)})
    ranks: dict[tuple[str, str], int] = field(default_factory=dict)
    special: list[str] = field(default_factory=list)
    special_ids: set[int] = field(default_factory=set)
    locked: list[str] = field(default_factory=list)

    @classmethod
    def new(cls, words: Words = Words()) -> Vocabulary:
        v = cls(special=list(words.special), locked=list(words.locked))
        for s in v.special:
            if s not in v.ids:
                v.ids[s] = len(v.ids)
                v.special_ids.add(v.ids[s])
        for w in v.locked:
            for form in (w, " " + w):
                v.ids.setdefault(byte_chars(form), len(v.ids))
        return v

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_cut", "_cut_ascii", "_cut_special", "tokens", "_known", "_bytes", "_merges")}

    @cached_property
    def _cut(self):
        return regex.compile(split_pattern(self.locked), regex.IGNORECASE)

    @cached_property
    def _cut_ascii(self):
        """The same for texts of ASCII alone, which the standard library cuts in less time."""
        pattern = split_pattern(self.locked).removesuffix(_PLAIN) + _PLAIN.replace(r"\p{L}+|\p{N}+", "[A-Za-z]+|[0-9]+").replace(r"\p{N}\p{L}", "0-9A-Za-z")
        return stdlib_re.compile(pattern, stdlib_re.IGNORECASE | stdlib_re.ASCII)

    @cached_property
    def _cut_special(self):
        return regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special_ids else None

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.ids.items()}

    @cached_property
    def _known(self) -> dict[str, bytes]:
        """The ids of a pre-token, as the bytes of numbers of four bytes."""
        return _Known(lambda token: array("i", map(self.ids.__getitem__, self.pieces(byte_chars(token)))).tobytes(), KEPT_WORDS)

    @cached_property
    def _bytes(self) -> dict[int, bytes]:
        """The bytes of an id."""
        return _Known(lambda i: self.tokens[i].encode("utf-8") if i in self.special_ids else bytes(map(CHAR_BYTE.__getitem__, self.tokens[i])), len(self.ids))

    def pieces(self, token: str) -> list[str]:
        """A pre-token, in byte characters, after all merges; as a whole if it is in the vocabulary."""
        if token in self.ids:
            return [token]
        parts, rank = list(token), self.ranks.get
        ranks = list(map(rank, zip(parts, parts[1:], strict=False), repeat(_NO_RANK)))
        while ranks and (least := min(ranks)) != _NO_RANK:
            at = 0
            for _ in range(ranks.count(least)):  # every place of the pair, from the left; those that overlap go with the first
                try:
                    at = ranks.index(least, at)
                except ValueError:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank((parts[at - 1], parts[at]), _NO_RANK)
                if at < len(ranks):
                    ranks[at] = rank((parts[at], parts[at + 1]), _NO_RANK)
        return parts

    def encode_bytes(self, text: str) -> bytes:
        """Ids of text whose scopes are marked already, as the bytes of numbers of four bytes."""
        out, known = [], self._known.__getitem__
        for segment in self._cut_special.split(text) if self._cut_special else [text]:
            if segment and self.ids.get(segment) in self.special_ids:
                out.append(np.int32(self.ids[segment]).tobytes())
            else:
                out += map(known, (self._cut_ascii if segment.isascii() else self._cut).findall(segment))
        return b"".join(out)

    @cached_property
    def _merges(self) -> tuple[np.ndarray, ...] | None:
        """Ids of the bytes, and pairs of ids (as one number, in order) with their ranks and what they become; null if ids don't stand for all of these."""
        try:
            made = sorted((self.ids[a] << 32 | self.ids[b], rank, self.ids[a + b]) for (a, b), rank in self.ranks.items())
            single = [self.ids[BYTE_CHAR[b]] for b in range(256)]
        except KeyError:
            return None
        if len(set(self.ids.values())) < len(self.ids) or min(self.ids.values()) < 0:
            return None
        return np.array(single, dtype=np.int64), *np.array(made, dtype=np.int64).reshape(-1, 3).T.copy()

    def _find(self, tokens: list[str]) -> None:
        """Put the ids of pre-tokens at hand. They lie in one array, and in each turn all of them merge their pair of least rank, so that a turn is a few steps over arrays."""
        known, cut = self._known, []
        if self._merges is None or not self.ranks:
            for t in tokens:
                known[t] = known.find(t)
            return
        single, codes, ranks, becomes = self._merges
        for t in tokens:
            if (whole := self.ids.get(byte_chars(t))) is None:
                cut.append(t)
            else:
                known[t] = np.int32(whole).tobytes()
        data = [t.encode("utf-8") for t in cut]
        piece = single[np.frombuffer(b"".join(data), dtype=np.uint8)]
        word = np.repeat(np.arange(len(data)), [len(d) for d in data])
        over: list[tuple[np.ndarray, np.ndarray]] = []
        while len(piece):
            code = np.append(piece[:-1] << 32 | piece[1:], -1)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            rank = np.where((codes[at] == code) & np.append(word[:-1] == word[1:], False), ranks[at], _NO_RANK)
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(begins, append=len(word)))
            live = least < _NO_RANK
            over.append((word[~live], piece[~live]))
            hit = np.flatnonzero((rank == least) & live)
            # Of places that overlap, every second one, from the left.
            first = np.diff(hit, prepend=-2) > 1
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))) % 2 == 0] if len(hit) else hit
            piece[hit] = becomes[at[hit]]
            live[hit + 1] = False
            piece, word = piece[live], word[live]
        if over:
            word, piece = (np.concatenate(x) for x in zip(*over, strict=True))
            held = piece[np.argsort(word, kind="stable")].astype(np.int32).tobytes()
            ends = (np.cumsum(np.bincount(word, minlength=len(cut))) * 4).tolist()
            known.update(zip(cut, (held[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def encode_many(self, texts: Iterable[str]) -> list[bytes]:
        """encode_bytes() of each text; pre-tokens that aren't at hand are found together."""
        known, split = self._known, self._cut_special.split if self._cut_special else lambda t: [t]
        cut = [[[x] if x and self.ids.get(x) in self.special_ids else (self._cut_ascii if x.isascii() else self._cut).findall(x) for x in split(t)] for t in texts]
        special = {w: np.int32(self.ids[w]).tobytes() for w in self.special if self.ids.get(w) in self.special_ids}
        every = set(chain.from_iterable(chain.from_iterable(cut))).difference(special)
        if len(known) + len(fresh := every.difference(known)) > self._known.most:
            known.clear()
            fresh = every
        self._find(list(fresh))
        at_hand = known.__getitem__
        return [b"".join([special[p[0]] if len(p) == 1 and p[0] in special else b"".join(map(at_hand, p)) for p in parts]) for parts in cut]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of text whose scopes are marked already."""
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def encode(self, text: str, add_eos: bool = False) -> list[int]:
        return self.encode_plain(preprocess(text, add_eos))

    def decode_plain(self, ids: Iterable[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: Iterable[int], tab_width: int = 4) -> str:
        return postprocess(self.decode_plain(ids), tab_width)

    def save(self, folder: str | Path) -> None:
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        data = {"vocab": self.ids, "merges": [f"{a} {b}" for a, b in sorted(self.ranks, key=self.ranks.__getitem__)], "special_tokens": self.special, "special_ids": sorted(self.special_ids), "locked": self.locked}
        (folder / "tokenizer.json").write_text(json.dumps(data, indent=2))
        (folder / "tokenizer_config.json").write_text(json.dumps({"indent": INDENT, "dedent": DEDENT, "eos": EOS}, indent=2))

    @classmethod
    def load(cls, folder: str | Path) -> Vocabulary:
        data = json.loads((Path(folder) / "tokenizer.json").read_text())
        ranks = {(left, right): rank for rank, (left, right) in enumerate(map(str.split, data["merges"]))}
        return cls({k: int(i) for k, i in data["vocab"].items()}, ranks, list(data.get("special_tokens", [])), set(data.get("special_ids", [])), list(data.get("locked", [])))

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        """(token, id) and (left, right, rank) as tables."""
        return spark.createDataFrame(list(self.ids.items()), "token string, id int"), spark.createDataFrame([(a, b, r) for (a, b), r in self.ranks.items()], "left string, right string, rank int")


def merged(parts: list[str], pair: tuple[str, str]) -> list[str]:
    """parts with every occurrence of the pair, from the left, made one."""
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


# --- training


def pretoken_counts(docs: DataFrame, locked: Iterable[str] = (), text_col: str = "text") -> DataFrame:
    """(token, freq) over all texts."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(java_pattern(locked)), F.lit(0))
    return docs.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, cnt) of neighbours in words (pieces: array, freq), each as often as its word."""
    at = F.sequence(F.lit(1), F.size("pieces") - 1)
    both = F.transform(at, lambda i: F.struct(F.element_at("pieces", i).alias("left"), F.element_at("pieces", i + 1).alias("right")))
    return words.where(F.size("pieces") > 1).select("freq", F.explode(both).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("cnt"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair, the least in order on a tie."""
    return pairs.orderBy(F.desc("cnt"), "left", "right").limit(1)


def learn_merges(vocabulary: Vocabulary, counts: dict[str, int], size: int) -> Vocabulary:
    """Merge the most frequent pair, the least in order on a tie, until the vocabulary has had `size` - its own size turns or no pair is left.

    All words lie in one array of pieces, each with its neighbours' places. A pair's places are kept as they arise, and those that are
    no longer its own are left out when it is merged, so that a turn costs what it changes, in a few steps over arrays.
    """
    turns = size - len(vocabulary.ids)
    encoded = [w.encode("utf-8") for w in counts]
    ends = np.cumsum([len(e) for e in encoded], dtype=np.int64)
    piece = np.frombuffer(b"".join(encoded), dtype=np.uint8).astype(np.int64)
    place = np.arange(len(piece))
    after, before = place + 1, place - 1
    some = ends[np.diff(ends, prepend=0) > 0]
    after[some - 1] = before[np.append(0, some[:-1]) if len(some) else some] = -1
    weight = np.repeat(np.array(list(counts.values()), dtype=np.float64), np.diff(ends, prepend=0))  # exact below 2^53
    names = [BYTE_CHAR[b] for b in range(256)]
    number = {c: i for i, c in enumerate(names)}
    count: dict[int, int] = defaultdict(int)
    where: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[tuple[int, str, str, int]] = []

    def tally(left: np.ndarray, keep: bool) -> dict[int, int]:
        """How often each pair of the pieces at these places and behind them occurs; if `keep`, the places are noted."""
        code = piece[left] << 32 | piece[after[left]]
        order = np.argsort(code, kind="stable")
        code, left = code[order], left[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if keep:
            for c, own in zip(code[first].tolist(), np.split(left, first[1:]) if len(first) else [], strict=True):
                where[c].append(own)
        return dict(zip(code[first].tolist(), np.add.reduceat(weight[left], first).tolist() if len(first) else [], strict=True))

    def push(changed: Iterable[int]) -> None:
        for c in changed:
            if count[c] > 0:
                heapq.heappush(heap, (-count[c], names[c >> 32], names[c & 0xFFFFFFFF], c))

    count.update((c, int(n)) for c, n in tally(place[after >= 0], True).items())
    push(list(count))
    while turns > 0 and heap:
        n, left_name, right_name, code = heapq.heappop(heap)
        if count.get(code) != -n:
            continue  # of an older count
        turns -= 1
        left, right = code >> 32, code & 0xFFFFFFFF
        new = _record(vocabulary, (left_name, right_name))
        if new not in number:
            number[new] = len(names)
            names.append(new)
        at = np.unique(np.concatenate(where.pop(code)))
        at = at[(piece[at] == left) & (after[at] >= 0)]
        at = at[piece[after[at]] == right]
        if left == right:  # of a run, every second place, from the left
            begins = np.ones(len(at), dtype=bool)
            begins[1:] = after[at[:-1]] != at[1:]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
        gone, behind = after[at], after[after[at]]
        old = tally(np.unique(np.concatenate([before[at][before[at] >= 0], at, gone[behind >= 0]])), False)
        piece[at], piece[gone] = number[new], -1
        after[at] = behind
        before[behind[behind >= 0]] = at[behind >= 0]
        fresh = tally(np.unique(np.concatenate([before[at][before[at] >= 0], at[behind >= 0]])), True)
        for c, k in old.items():
            count[c] -= int(k)
        for c, k in fresh.items():
            count[c] += int(k)
        push(old.keys() | fresh.keys())
    for kept in ("tokens", "_known", "_bytes", "_merges"):
        vocabulary.__dict__.pop(kept, None)
    return vocabulary


def _record(vocabulary: Vocabulary, pair: tuple[str, str]) -> str:
    vocabulary.ranks[pair] = len(vocabulary.ranks)
    vocabulary.ids.setdefault(pair[0] + pair[1], len(vocabulary.ids))
    return pair[0] + pair[1]


def train(docs: DataFrame, size: int, words: Words = Words(), text_col: str = "text", split_specials: bool = False) -> Vocabulary:
    """A vocabulary learned from all texts of docs. By default special words in the texts count as ordinary text, unlike at encoding."""
    if split_specials:
        parts = F.split(F.col(text_col), "|".join(stdlib_re.escape(s) for s in words.special))
        docs, text_col = docs.select(F.explode(parts).alias("text")), "text"
    counts = pretoken_counts(docs, words.locked, text_col)
    n = counts.count()
    if not n:
        raise ValueError("no text to learn from")
    if n > MOST_WORDS:
        raise MemoryError(f"{n} distinct pre-tokens are more than the {MOST_WORDS} that the driver takes; train on fewer documents")
    rows = counts.toPandas()  # in any order: ties go by the pieces themselves
    return learn_merges(Vocabulary.new(words), dict(zip(rows["token"], rows["freq"].tolist(), strict=True)), size)


# --- scopes


def mark_scopes(code: str) -> str:
    """Indentation as markers: each line starts with what it changes, blank lines stay, and a last line closes what is open."""
    out, width, level = [], None, 0
    for line in code.split("\n"):
        bare = line.lstrip(" \t")
        if not bare:
            out.append(line)
            continue
        spaces = len(line) - len(bare)
        width = width or spaces or None
        deep, over = divmod(spaces, width or 4)
        out.append((INDENT * (deep - level) if deep > level else DEDENT * (level - deep)) + " " * over + bare)
        level = deep
    return "\n".join(out + [DEDENT * level] * (level > 0))


def preprocess(text: str, add_eos: bool = False) -> str:
    """text with the bodies of its fenced blocks marked."""

    def block(m):
        begin, end = (x - m.start() for x in m.span(1))
        return m.group()[:begin] + mark_scopes(m.group(1)) + m.group()[end:]

    return _FENCED.sub(block, text) + (EOS if add_eos else "")


def postprocess(text: str, tab_width: int = 4) -> str:
    """The text up to its end mark, with markers turned into indentation again."""
    out, level = [], 0
    for line in _MIDDLE.sub("", text.partition(EOS)[0]).split("\n"):
        parts = regex.split(r"(<\|(?:in|de)dent\|>)", line)
        for p in parts[1::2]:
            level = level + 1 if p == INDENT else max(0, level - 1)
        bare = "".join(parts[::2])
        if bare or len(parts) == 1:
            out.append(" " * (level * tab_width) + bare if bare else "")
    return "\n".join(out)


# --- columns


#: The vocabularies of this process by their content, so that functions and tasks of one worker share what is found.
_SHARED: dict[str, Vocabulary] = {}


def _shared(vocabulary: Vocabulary, key: str) -> Vocabulary:
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = vocabulary
    return _SHARED[key]


def _key(vocabulary: Vocabulary) -> str:
    return hashlib.md5(repr(vocabulary.__getstate__()).encode()).hexdigest()


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where rows of these sizes are cut, so that those between take about BYTES_AT_A_TIME, or are one."""
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BYTES_AT_A_TIME, "right")))
        yield begin, end
        begin = end


def _encoded(v: Vocabulary, texts: pa.Array, add_eos: bool, plain: bool) -> pa.Array:
    """Lists of ids, which lie in one buffer of four bytes each; no Python list of them is made."""
    given = [t for t in texts.to_pylist() if t is not None]
    made = iter(v.encode_many(given if plain else (preprocess(t, add_eos) for t in given)))
    held = [b"" if null else next(made) for null in texts.is_null().to_pylist()]
    ends = np.cumsum([0, *map(len, held)], dtype=np.int64) // 4
    ids = b"".join(held)
    values = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=texts.is_null() if texts.null_count else None)


def _bytes_of(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_udf(vocabulary: Vocabulary, add_eos: bool = False, plain: bool = False):
    """text -> array of ids. Null stays null. Ids are handed on by portions of a batch, so that no batch's ids are held whole."""
    key = _key(vocabulary)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _shared(vocabulary, key)
        for texts in batches:
            for begin, end in _portions(_bytes_of(texts)):
                yield _encoded(v, texts.slice(begin, end - begin), add_eos, plain)

    return run


def encode_sides_udf(vocabulary: Vocabulary):
    """array of texts -> array of their arrays of ids, with one Python function for all sides of an example."""
    key = _key(vocabulary)

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _shared(vocabulary, key)
        for rows in batches:
            ends = rows.offsets.to_numpy().astype(np.int64)
            size = np.append(0, np.cumsum(_bytes_of(rows.values)))[ends]
            for begin, end in _portions(np.diff(size)):
                texts = rows.values.slice(ends[begin], ends[end] - ends[begin])
                yield pa.ListArray.from_arrays(pa.array((ends[begin : end + 1] - ends[begin]).astype(np.int32)), _encoded(v, texts, False, False))

    return run


def decode_udf(vocabulary: Vocabulary, tab_width: int = 4):
    key = _key(vocabulary)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _shared(vocabulary, key)
        for ids in batches:
            for begin in range(0, len(ids), AT_A_TIME):
                yield pa.array([None if i is None else v.decode(i, tab_width) for i in ids.slice(begin, AT_A_TIME).to_pylist()], pa.string())

    return run


def encode_distinct(docs: DataFrame, vocabulary: Vocabulary, key: str = "ord", text_col: str = "text") -> DataFrame:
    """(key, ids) of texts without special words: every distinct pre-token of the whole table is encoded once, and joined back."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(java_pattern(vocabulary.locked)), F.lit(0))
    each = docs.select(key, F.posexplode(found).alias("pos", "token"))
    encode = encode_udf(vocabulary, plain=True)
    known = each.select("token").distinct().select("token", encode("token").alias("part"))
    held = each.join(known, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    made = held.select(key, F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"))
    return docs.select(key).join(made, key, "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def compile_corpus(docs: DataFrame, vocabulary: Vocabulary, fim_rate: float = 0.15, key: str = "ord", text_col: str = "text") -> DataFrame:
    """(key, ids): each document encoded, with probability fim_rate reordered around its middle, and ended."""
    from corpuskit.config import Sentinels
    from corpuskit.operators.examples import filled_in_middle, with_end

    s = Sentinels(*(vocabulary.ids[f"<|{w}|>"] for w in ("eos", "fim_prefix", "fim_middle", "fim_suffix")))
    # Asked of the text, as a filter on the ids would encode once more.
    encoded = docs.where(F.col(text_col).isNotNull()).select(key, encode_udf(vocabulary)(F.col(text_col)).alias("ids"))
    return encoded.select(key, with_end(filled_in_middle(F.col("ids"), F.col(key), fim_rate, s), s.eos).alias("ids"))


def encode_examples(rows: DataFrame, vocabulary: Vocabulary, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """rows with ids and prompt_len; the two sides are encoded apart, so that the boundary is exact."""
    out = rows.withColumn("__s", encode_sides_udf(vocabulary)(F.array(prompt, completion)))
    return out.withColumn("ids", F.concat(F.col("__s")[0], F.col("__s")[1])).withColumn("prompt_len", F.size(F.col("__s")[0])).drop("__s")


def encode_pairs(rows: DataFrame, vocabulary: Vocabulary, block: int) -> DataFrame:
    """rows (prompt, chosen, rejected) with both sides as (ids, prompt_len), where both fit in the block."""
    out = rows.withColumn("__s", encode_sides_udf(vocabulary)(F.array("prompt", "chosen", "rejected")))
    out = out.withColumns({c: F.col("__s")[i] for i, c in enumerate(("__p", "__c", "__r"))}).drop("__s")
    side = lambda c: F.struct(F.concat("__p", c).alias("ids"), F.size("__p").alias("prompt_len"))
    out = out.withColumn("chosen", side("__c")).withColumn("rejected", side("__r")).drop("__p", "__c", "__r")
    return out.where(F.greatest(F.size("chosen.ids"), F.size("rejected.ids")) <= block)


def shown_mask(examples: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """examples (x, y) with the prompt and what is trained on as text; "<empty>" where that is nothing."""
    decode = decode_udf(vocabulary)
    supervised = F.filter("y", lambda v: v != -1)
    first = F.array_position(F.transform("y", lambda v: (v != -1).cast("int")), 1).cast("int")
    prompt = F.when(first > 0, F.slice("x", F.lit(1), first)).otherwise(F.col("x"))
    out = examples.withColumn("__p", prompt).withColumn("__s", supervised)
    return out.withColumn("prompt_text", decode("__p")).withColumn("supervised_text", F.when(F.size("__s") > 0, decode("__s")).otherwise("<empty>")).drop("__p", "__s")
