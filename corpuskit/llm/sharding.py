"""Shards of equal bytes, sorted by key, by histogram sort.

To split documents into key ranges of equal bytes, the exact bytes below candidate boundaries are counted across all
partitions; of each boundary's interval only the part around its target remains, is probed again, and so on until
a boundary's bytes are within the tolerance of its target or its interval holds a single key. Only keys and byte
numbers are read for that, from a checkpointed copy; the documents move once, straight to their shard, and are sorted there.

Defined results: equal keys are never parted, so a shard may exceed its share by one key's bytes; a null key sorts first
(below all others); a null text has 0 bytes; if all keys are equal there is one shard that isn't empty; repeated rows stay;
rows of one key are in no order among themselves; a text counts with all its bytes, however many, and an empty one with none; an
empty table gives an empty one. All columns are kept beside shard, sort_key and n_bytes; a column of one of these names gets
an underscore at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut, free_name

SHARD_BYTES, TOLERANCE, PROBES, MOST_PROBES = 32 << 20, 0.01, 32, 1 << 22
#: Keys are above this; a null key takes it.
LEAST = -(2**63)


def hash_key(column: Column | str) -> Column:
    """A 60-bit key that puts rows in a random but fixed order."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column), 1, 15), 16, 10).cast("bigint")


def _histogram(probes: np.ndarray):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(probes) + 1)
        for b in batches:
            total += np.bincount(np.searchsorted(probes, b["k"].to_numpy(), side="right"), weights=b["n"].to_numpy(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at.astype(np.int64), "n": total[at].astype(np.int64)})

    return count


def bytes_below(sized: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Of the rows (k, n), the sum of n over keys below each of the sorted probes, exactly."""
    counts = sized.mapInPandas(_histogram(probes), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(probes) + 1, dtype=np.int64)
    total[counts["i"].to_numpy()] = counts["n"].to_numpy()
    return np.cumsum(total)[:-1]


def splitters(sized: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES, most: int = MOST_PROBES) -> np.ndarray:
    """shards - 1 keys; the shard of a key is the number of splitters that are at most the key. sized has (k bigint, n bigint). A round tries `most` keys at most, of each boundary's interval one at least."""
    first, last, total = sized.agg(F.min("k"), F.max("k"), F.sum("n")).first()
    if shards < 2 or first is None:
        return np.zeros(0, dtype=np.int64)
    target = np.array([total * j // shards for j in range(1, shards)] if total > 2**62 // shards else total * np.arange(1, shards, dtype=np.int64) // shards, dtype=np.int64)
    slack = tolerance * total / shards
    # Bytes below lo are at most the target, those below hi at least; the answer is in between. Keys are counted from the first one, as unsigned numbers, so that no width overflows.
    base = np.uint64(first & (2**64 - 1))
    signed = lambda x: (x + base).view(np.int64)
    lo, hi = np.zeros(len(target), dtype=np.uint64), np.full(len(target), min(last + 1 - first, 2**64 - 1), dtype=np.uint64)
    below_lo, below_hi = np.zeros(len(target), dtype=np.int64), np.full(len(target), total, dtype=np.int64)
    while True:
        left = np.flatnonzero((np.minimum(target - below_lo, below_hi - target) > slack) & (hi - lo > 1))
        if not len(left):
            break
        # Boundaries that share an interval share its probes.
        edges, count = np.unique(np.stack([lo[left], hi[left]], axis=1), axis=0, return_counts=True)
        width = edges[:, 1] - edges[:, 0]
        each = np.minimum(np.maximum(1, (min(probes, max(1, most // len(left))) * count)).astype(np.uint64), width - np.uint64(1))
        at = np.repeat(np.arange(len(edges)), each.astype(np.int64))
        nth = np.arange(len(at)) - np.repeat(np.cumsum(each.astype(np.int64)) - each.astype(np.int64), each.astype(np.int64)) + 1
        step, over = width // (each + np.uint64(1)), width % (each + np.uint64(1))
        u = nth.astype(np.uint64)
        tried = np.unique(np.concatenate([edges[at, 0] + step[at] * u + over[at] * u // (each[at] + np.uint64(1)), edges[:, 0] + np.uint64(1)]))
        below = bytes_below(sized, signed(tried))
        spot = np.searchsorted(below, target[left], side="right")
        low = np.maximum(spot - 1, 0)
        rise = (spot > 0) & (tried[low] > lo[left])
        lo[left[rise]], below_lo[left[rise]] = tried[low[rise]], below[low[rise]]
        high = np.minimum(spot, len(tried) - 1)
        fall = (spot < len(tried)) & (tried[high] < hi[left])
        hi[left[fall]], below_hi[left[fall]] = tried[high[fall]], below[high[fall]]
    return signed(np.where(target - below_lo <= below_hi - target, lo, hi))


def shard(docs: DataFrame, key: Column, text_col: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with shard, sort_key and n_bytes, one partition a shard, sorted by key within it. Without a number of shards, there are as many as shard_bytes asks for."""
    held = free_name(docs, "held_key")
    docs = docs.withColumn(held, F.coalesce(key.cast("bigint"), F.lit(LEAST)))
    for name in ("shard", "sort_key", "n_bytes"):
        for c in [c for c in docs.columns if c.lower() == name]:
            new = free_name(docs, name)
            docs = docs.withColumnRenamed(c, new)
            text_col = new if text_col == c else text_col
    size, key = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"), F.col(held)
    sized = cut(docs.select(key.alias("k"), size.alias("n")))
    if shards is None:
        shards = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // shard_bytes))
    found = splitters(sized, shards, tolerance)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(found, keys.to_numpy(), side="right").astype(np.int32))

    placed = docs.withColumnRenamed(held, "sort_key").withColumn("n_bytes", size).withColumn("shard", place("sort_key"))
    return placed.repartitionById(shards, "shard").sortWithinPartitions("sort_key")
