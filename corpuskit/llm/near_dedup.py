"""Near duplicates by Order MinHash, verified by banded alignment.

Each document's word k-mers are labelled with their occurrence number, so that repetition counts.
Each sketch takes the `ell` labelled k-mers of least hash and keeps them in the order of the text: two
documents agree on a sketch if they share these k-mers and their order, which follows their edit
similarity rather than the overlap of their sets. Pairs that agree on any sketch are candidates; a
candidate stands if the edit distance of the two word sequences, by a bit-parallel alignment in
the band that the threshold allows, is at most (1 - threshold) x the longer one's words.

Exact copies share a row from the start, so buckets and edges are of distinct texts. A bucket's members are held against its
least id first, then those still apart against each other. Passages that many documents share fill buckets with
documents that aren't similar; a bucket of over LEAF members is therefore refined, as in an LSH forest, by each of the next SPAN
sketches in turn, down to DEPTH sketches, and in every such bucket members of like length are held against the least id
among them, so that large groups of copies are mostly found by their least ids. What is still apart in a bucket of over LEAF members is
then compared in blocks of BLOCK of like length: only pairs whose counts of words, in BINS bins, allow the distance are aligned, first each
member with the nearest of every other group, then the rest. So every two documents that agree on a sketch are
in one group or were compared; the counts are quadratic in the documents that share a sketch without being copies.

Defined results: a null text is never a duplicate; texts without words are duplicates where they are equal; a
text of fewer than k words is one k-mer; rows of one id are copies of each other, and the text of an id that has several is its
least; rows of null id have no name for a pair, so they pass unchanged and ungrouped; very long texts are hashed and aligned whole;
of texts that are equally similar none is preferred, as the group is all that are linked. An empty table gives an empty one. Only the
id and text columns are read; others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut, free_name, maybe_broadcast
from corpuskit.llm._text import mix, pieces, shingles, word_hashes

K, ELL, SKETCHES, THRESHOLD = 3, 2, 32, 0.75
LEAF, SPAN, DEPTH = 64, 4, 4
BLOCK, BINS = 1024, 512

_PLACE_BITS = 24
_LOW = np.uint64((1 << _PLACE_BITS) - 1)
_MAX = np.uint64(2**64 - 1)
_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _labelled(kmers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with the number of its earlier occurrences in its text mixed in."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = kmers ^ mix(text + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return kmers
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    occurrence = np.empty(len(key), dtype=np.uint64)
    occurrence[order] = (np.arange(len(key)) - first).astype(np.uint64)
    return np.where(occurrence > 0, mix(kmers + occurrence * np.uint64(0x9E3779B97F4A7C15)), kmers)


def order_sketches(texts: Sequence[str | None], k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(sketches of each text with words, as rows; the number of words of each text)."""
    words, offsets = word_hashes(texts)
    kmers, offsets_k = shingles(words, offsets, k)
    some = np.diff(offsets_k) > 0
    out = np.zeros((int(some.sum()), sketches), dtype=np.uint64)
    if not len(out):
        return out, np.diff(offsets)
    labelled = _labelled(kmers, offsets_k)
    starts, lengths = offsets_k[:-1][some], np.diff(offsets_k)[some]
    place = (np.arange(len(kmers)) - np.repeat(starts, lengths)).astype(np.uint64)
    bits = place >> np.uint64(_PLACE_BITS)  # above 0 only in texts of over 16 million words
    place &= _LOW
    for s in range(sketches):
        key = labelled * _MULTIPLIERS[s]
        key &= ~_LOW
        key |= place
        if bits.any():
            key += bits << np.uint64(_PLACE_BITS)
        taken = np.full((ell, len(starts)), -1, dtype=np.int64)
        for j in range(ell):
            least = np.minimum.reduceat(key, starts)
            there = least != _MAX
            at = starts + (least & _LOW).astype(np.int64)
            if bits.any():
                at = _positions(key, least, starts, lengths)
            taken[j, there] = at[there]
            key[at[there]] = _MAX
        taken.sort(axis=0)
        value = np.full(len(starts), mix(np.array([s + 1], dtype=np.uint64))[0], dtype=np.uint64)
        for j in range(ell):
            value += np.where(taken[j] >= 0, labelled[np.maximum(taken[j], 0)], np.uint64(0)) * _ORDER[j]
        out[:, s] = mix(value)
    return out, np.diff(offsets)


def _positions(key: np.ndarray, least: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each text's least key is, for texts too long to hold the place in the key."""
    return np.array([a + int(np.argmax(key[a : a + n] == v)) for v, a, n in zip(least, starts, lengths, strict=True)])


def banded_distance(a: Sequence, b: Sequence, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is above `most`; only the 2 x most + 1 diagonals that can matter are aligned."""
    begin, end = 0, min(len(a), len(b))
    while begin < end and a[begin] == b[begin]:
        begin += 1
    tail = 0
    while tail < end - begin and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[begin : len(a) - tail], b[begin : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    if not most:
        return 1
    most_given, most = most, min(most, n)
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    plus, minus = full << (width - most - 1) & full, 0
    top, row, shift, distance = 1 << (width - 1), 1 << (width - 2), most + 1 - width, most
    stop = most + m - (n - most)
    for i, x in enumerate(b):
        hit = where.get(x, 0)
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        diagonal = (((hit & plus) + plus) ^ plus | hit | minus) & full
        across_plus = (minus | ~(diagonal | plus)) & full
        across_minus = diagonal & plus
        if i < n - most:
            distance += not diagonal & top
        else:
            distance += bool(across_plus & row) - bool(across_minus & row)
            row >>= 1
        if distance > stop:
            return most_given + 1
        down = diagonal >> 1
        plus = (across_minus | ~(down | across_plus)) & full
        minus = down & across_plus
        shift += 1
    return distance if distance <= most_given else most_given + 1


def similar(a: str, b: str, threshold: float = THRESHOLD) -> bool:
    """Whether the edit similarity of two texts' words, 1 - distance / words of the longer, reaches the threshold."""
    words, offsets = word_hashes([a, b])
    return _similar(words[: offsets[1]].tolist(), words[offsets[1] :].tolist(), threshold)


def _similar(a: list[int], b: list[int], threshold: float) -> bool:
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) <= most


def _sketch_udf(k: int, ell: int, sketches: int):
    @F.pandas_udf("struct<key: string, words: bigint, sketches: array<bigint>>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys: list = []
            rows: list = []
            counts: list = []
            values = texts.tolist()
            for piece in pieces(values):
                part = values[piece]
                found, n = order_sketches(part, k, ell, sketches)
                words, offsets = word_hashes(part)
                counts += n.tolist()
                each = iter(found.view(np.int64).tolist())
                for i, text in enumerate(part):
                    if n[i]:
                        own = words[offsets[i] : offsets[i + 1]]
                        at = np.arange(len(own), dtype=np.uint64)
                        two = (int(np.bitwise_xor.reduce(mix(own + at * _ORDER[j]))) for j in (1, 2))
                        keys.append("%016x%016x" % tuple(two) + f"{len(own):x}")
                        rows.append(next(each))
                    else:
                        keys.append(None if text is None else "-" + md5(text.encode("utf-8", "surrogatepass")).hexdigest())
                        rows.append(None)
            yield pd.DataFrame({"key": keys, "words": counts, "sketches": rows})

    return sketch


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (a, text_a, text_b) in enumerate(zip(batch["a"], batch["text_a"], batch["text_b"], strict=True)):
                if last[0] != a:
                    last = (a, word_hashes([text_a])[0].tolist())
                keep[i] = _similar(last[1], word_hashes([text_b])[0].tolist(), threshold)
            yield batch.loc[keep, ["a", "b"]]

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts (id, text) are similar enough."""
    named = maybe_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = texts.join(named, "id", "left_semi")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInPandas(_verify(threshold), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, least id reachable) for all ids in the edges (a, b): large and small stars by turns until nothing changes. Neighbours are joined, never gathered."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(star.unionByName(near.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ell: int = ELL, sketches: int = SKETCHES, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, group_id, kept, links) for each id: group_id is the least id of its group, which alone is kept; links counts its exact copies and the other texts that it was found similar to."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if not _unique(texts):
        texts = cut(texts.groupBy("id").agg(F.min("text").alias("text")))
    made = _sketch_udf(k, ell, sketches)("text")
    key = F.coalesce("s.key", F.concat(F.lit("null"), F.col("id").cast("string")))
    exact = cut(texts.withColumn("s", made).select("id", key.alias("key"), F.col("s.words").alias("words"), F.col("s.sketches").alias("sketches")))
    # From here on a row a distinct text, under the least id that has it: exact copies are in no bucket and no edge.
    distinct = exact.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("words").alias("words"), F.first("sketches").alias("sketches"))
    distinct = cut(distinct)
    sketched = distinct.where("sketches is not null").select("id", "words", "sketches")
    stars, leaves, hot = _candidates(sketched, sketches, threshold)
    edges = cut(verified(stars, texts, threshold))
    linked = components(edges)
    rest = cut(_left_over(leaves, linked, threshold))
    if not rest.isEmpty():
        more = cut(verified(rest, texts, threshold))
        edges, linked = edges.unionByName(more), _joined(linked, more)
    edges, linked = _hot_linked(hot, edges, linked, sketched, texts, threshold)
    degree = edges.distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    named = distinct.select("key", "id", "n").join(linked, "id", "left").join(degree, "id", "left")
    named = named.select("key", F.coalesce("root", "id").alias("group_id"), (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("links"))
    out = exact.select("id", "key").join(named, "key")
    return out.select(F.col("id").alias(id_col), "group_id", (F.col("group_id") == F.col("id")).alias("kept"), "links")


def _joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    return components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))


def _unique(texts: DataFrame) -> bool:
    """Whether no id occurs twice; cheap, as only the ids are read."""
    n, distinct = texts.agg(F.count("*"), F.count_distinct("id")).first()
    return n == distinct


def _candidates(docs: DataFrame, sketches: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (a, b) of least ids and the others in their buckets, buckets (m: array of (id, words)) of 2 to LEAF members, members (h, id, words) of the larger buckets of one sketch)."""
    by = float(-2 * np.log(threshold)) * (1 + 1e-9)
    # A sketch's number is part of its value, so that h alone names the bucket.
    level = docs.select("id", "words", F.posexplode("sketches").alias("i", "h"))
    stars, leaves = [], []
    for depth in range(DEPTH):
        # Sizes are counted with partial aggregates; only leaves are gathered into arrays.
        sizes = level.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        shared = cut(level.join(sizes, "h"))
        leaf = shared.where(F.col("n") <= LEAF).groupBy("h").agg(F.array_sort(F.collect_set(F.struct("id", "words"))).alias("m")).select("m")
        leaves.append(leaf)
        stars.append(leaf.select(F.col("m")[0]["id"].alias("a"), F.explode(F.transform("m", lambda x: x["id"])).alias("b")))
        hot = shared.where(F.col("n") > LEAF).select("i", "h", "id", "words")
        hottest = hot.drop("i") if depth == 0 else hottest
        # Classes of length are twice as wide as the threshold allows and overlap by half, so that any two lengths within it have one in common.
        place = F.log("words") / by
        classed = hot.select("h", "id", F.explode(F.array(F.floor(place), F.floor(place + 0.5) + 1_000_000)).alias("c"))
        firsts = classed.groupBy("h", "c").agg(F.min("id").alias("a"))
        stars.append(classed.join(firsts, ["h", "c"]).select("a", F.col("id").alias("b")))
        if depth == DEPTH - 1 or hot.isEmpty():
            break
        more = hot.join(docs.select("id", "sketches"), "id")
        further = F.explode(F.sequence(F.lit(1), F.lit(min(SPAN, sketches - 1)))).alias("o")
        more = more.select("id", "words", "h", "sketches", "i", further).withColumn("i", (F.col("i") + F.col("o")) % sketches)
        level = more.select("id", "words", "i", F.xxhash64("h", "o", F.get("sketches", F.col("i"))).alias("h"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return cut(union(stars).where("a <> b").distinct()), union(leaves), hottest


def _left_over(leaves: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a leaf's members of like length that aren't in one component yet."""
    each = leaves.distinct().select(F.xxhash64("m").alias("leaf"), F.explode("m").alias("x")).select("leaf", "x.id", "x.words")
    each = each.join(linked, "id", "left").select("leaf", F.struct("id", "words", F.coalesce("root", "id").alias("root")).alias("x"))
    apart = each.groupBy("leaf").agg(F.collect_list("x").alias("m")).where(F.size(F.array_distinct(F.transform("m", lambda x: x["root"]))) > 1)
    pairs = apart.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    pairs = pairs.where("x.id < y.id and x.root <> y.root").where(F.least("x.words", "y.words") >= threshold * F.greatest("x.words", "y.words") - 1e-9)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _bag_udf():
    @F.pandas_udf("binary")
    def bag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            values = texts.tolist()
            for piece in pieces(values):
                words, offsets = word_hashes(values[piece])
                place = (mix(words) % np.uint64(BINS)).astype(np.int64)
                # Counts are cut at a byte, which makes no two bags more unlike than they are.
                out += [np.minimum(np.bincount(place[a:b], minlength=BINS), 255).astype(np.uint8).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pd.Series(out)

    return bag


def _compared(threshold: float, nearest: bool):
    """Pairs of two blocks of a bucket that are in different components, first agree on its sketch and can be similar; if `nearest`, those of least bound for each member and component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["own"] == rows["p"]], rows[rows["own"] == rows["q"]]
        root = pd.factorize(pd.concat([x["root"], y["root"]]))[0]
        root_x, root_y = root[: len(x)], root[len(x) :]
        words_x, words_y = x["words"].to_numpy(), y["words"].to_numpy()
        longer = np.maximum(words_x[:, None], words_y)
        able = (np.minimum(words_x[:, None], words_y) >= threshold * longer - 1e-9) & (root_x[:, None] != root_y)
        at_x, at_y = np.nonzero(able)
        if rows["p"].iat[0] == rows["q"].iat[0]:
            at_x, at_y = at_x[at_x < at_y], at_y[at_x < at_y]
        found: list = []
        if len(at_x):
            sketch_x, sketch_y = np.stack(x["sketches"].to_numpy()), np.stack(y["sketches"].to_numpy())
            bag_x, bag_y = (np.frombuffer(b"".join(t["bag"]), dtype=np.uint8).reshape(-1, BINS).astype(np.int16) for t in (x, y))
            sum_x, sum_y = bag_x.sum(axis=1, dtype=np.int64), bag_y.sum(axis=1, dtype=np.int64)
            for begin in range(0, len(at_x), 8192):
                i, j = at_x[begin : begin + 8192], at_y[begin : begin + 8192]
                first = (sketch_x[i] == sketch_y[j]).argmax(axis=1)
                first = sketch_x[i, first] == rows["h"].iat[0]
                i, j = i[first], j[first]
                # Words of one that the other lacks have to be changed, added or taken away.
                bound = (np.abs(bag_x[i] - bag_y[j]).sum(axis=1, dtype=np.int64) + np.abs(sum_x[i] - sum_y[j])) // 2
                near = bound <= ((1 - threshold) * longer[i, j] + 1e-9).astype(np.int64)
                found.append(np.stack([i[near], j[near], bound[near]]))
        i, j, bound = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        if nearest:
            for side in (0, 1):
                one, other = (i, root_y[j]) if side == 0 else (j, root_x[i])
                order = np.lexsort((bound, other, one))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(one[order]) != 0) | (np.diff(other[order]) != 0)
                i, j, bound = i[order[new]], j[order[new]], bound[order[new]]
        return pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j]})

    return run


def _between(members: DataFrame, threshold: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) to align of the members (h, id, words, root, sketches, bag) of buckets, by blocks of about BLOCK of one class of length, each held against those of its own class and the next."""
    placed = members.withColumn("c", F.floor(F.log("words") / float(-np.log(threshold) * (1 + 1e-9))).cast("int"))
    blocks = placed.groupBy("h", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = cut(placed.join(blocks, ["h", "c"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks"))
    each = blocks.select("h", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    p = each.select("h", F.struct("c", "own").alias("p"), F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    both = p.join(each.select("h", "c", F.struct("c", "own").alias("q")), ["h", "c"]).where("p <= q").select("h", "p", "q")
    sides = both.select("h", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("own"))
    name = lambda x: F.concat_ws("/", F.col(f"{x}.c"), F.col(f"{x}.own"))
    sides = sides.select("h", "own.c", "own.own", name("p").alias("p"), name("q").alias("q"))
    kind = members.schema["id"].dataType.simpleString()
    placed = placed.join(sides, ["h", "c", "own"]).withColumn("own", F.concat_ws("/", "c", "own")).drop("c")
    pairs = placed.groupBy("h", "p", "q").applyInPandas(_compared(threshold, nearest), f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hot_linked(hot: DataFrame, edges: DataFrame, linked: DataFrame, docs: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """edges and linked, and what the members of large buckets that aren't in one component yet add to them."""
    tried = made = None
    for nearest in (True, False):
        each = hot.join(linked, "id", "left").select("h", "id", "words", F.coalesce("root", "id").alias("root"))
        mixed = each.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("h")
        apart = cut(each.join(mixed, "h"))
        if apart.isEmpty():
            break
        if made is None:
            ids = maybe_broadcast(apart.select("id").distinct())
            made = cut(texts.join(ids, "id", "left_semi").select("id", _bag_udf()("text").alias("bag")).join(docs.select("id", "sketches"), "id"))
        pairs = _between(apart.join(made, "id"), threshold, nearest)
        rest = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            break
        more = cut(verified(rest, texts, threshold))
        edges, linked = edges.unionByName(more), _joined(linked, more)
        tried = rest
    return edges, linked


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with one row of each group: that of its least id (of several rows of this id, one). Rows of null id stay."""
    gone = groups(docs, id_col, text_col, **parameters).where("not kept").select(F.col(id_col).alias("id"))
    rest = docs.join(gone, docs[id_col] == gone["id"], "left_anti")
    named = rest.where(F.col(id_col).isNotNull())
    if not _unique(named.select(F.col(id_col).alias("id"))):
        order = free_name(docs, "order")
        first = Window.partitionBy(id_col).orderBy(F.col(text_col), F.xxhash64(*docs.columns))
        named = named.withColumn(order, F.row_number().over(first)).where(F.col(order) == 1).drop(order)
    return named.unionByName(rest.where(F.col(id_col).isNull()))
