"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a share of the token budget by its weight (by default, its tokens to the power ALPHA); what a small
source can't use goes to the others. The share sets the inclusion probability of the source's documents. The flight
phase moves these probabilities, three documents at a time, along the null space of two constraints, the number
of tokens and of documents selected, at random but true to each probability, until each is 0 or 1. It runs
in buckets of a source side by side, then over what those leave undecided in each source, then, in buckets again, over what all
sources leave; the last few documents are landed by the coupling of least expected imbalance. So the totals of all
sources, and of each one, miss their targets by no more than a few documents.

Draws depend on ids and the seed alone, not on partitions. Defined results: rows of one id stand or fall together, as
one unit of all their tokens, in their least source; null ids are one unit; a null source is a source; a null or empty text has
0 tokens, and is balanced as a document; a very long one is a unit as any other; units of equal hashes go in order of tokens; a source without tokens has the budget's fraction for probability; a source with no
or non-positive weight is left out; an empty table gives an empty one. Only the id, source and text columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut, free_name, maybe_broadcast

FRACTION, ALPHA, SEED, UNITS = 0.7, 0.5, 1, 8192
_EPS = 1e-9


def probabilities(totals: DataFrame, budget: float, otherwise: float) -> DataFrame:
    """totals (s, tokens, weight) with pi, the inclusion probability of each source: its share of the budget by weight over its tokens, at most 1; what is over goes to the rest.

    With `by` tokens for each unit of weight, sources of fewer tokens than their share are taken whole, which leaves more for a unit of the others, until none is added.
    """
    open_ = (F.col("weight") > 0) & (F.col("tokens") > 0)
    by, before = 0.0, None
    while before != by:
        whole = open_ & (F.col("weight") * F.lit(by) >= F.col("tokens"))
        # Weights are added as decimals, so that no order of adding gives another sum.
        weight = F.sum(F.when(open_ & ~whole, F.col("weight").cast("decimal(38,12)"))).cast("double")
        full, rest = totals.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)).cast("double"), weight).first()
        if not rest:
            by, before = math.inf, math.inf
            break
        before, by = by, max(by, (budget - full) / rest)
    share = F.least(F.lit(1.0), F.col("weight") * F.lit(by) / F.col("tokens")) if math.isfinite(by) else F.lit(1.0)
    return totals.withColumn("pi", F.when(open_, share).when(F.col("weight") > 0, F.lit(float(otherwise))).otherwise(0.0))


def flight(pi: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """pi, moved until at most two are neither 0 nor 1; sum(pi) and sum(pi * tokens) stay."""
    out = [float(x) for x in pi]
    size = [float(x) for x in tokens]
    draw = np.random.default_rng(seed).random(2 * len(out) + 4)
    window: list[int] = []
    following = iter([i for i, x in enumerate(out) if _EPS < x < 1 - _EPS])
    n = 0
    while True:
        while len(window) < 3 and (i := next(following, None)) is not None:
            window.append(i)
        if len(window) == 3:
            a, b, c = (size[i] for i in window)
            u = [c - b, a - c, b - a]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(window) == 2 and size[window[0]] == size[window[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = down = math.inf
        for i, d in zip(window, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - out[i]) / d), min(down, out[i] / d)
            elif d < 0:
                up, down = min(up, out[i] / -d), min(down, (1 - out[i]) / -d)
        by = up if draw[n % len(draw)] * (up + down) < down else -down
        n += 1
        for i, d in zip(window, u, strict=True):
            out[i] += by * d
            if out[i] < _EPS or out[i] > 1 - _EPS:
                out[i] = float(round(out[i]))
        window = [i for i in window if 0 < out[i] < 1]
    return np.array(out)


def land(pi: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """0 or 1 for each of at most two undecided units, true to their probabilities, with the least expected squared imbalance."""
    out = np.array(pi, dtype=float)
    left = np.flatnonzero((out > 0) & (out < 1))
    draw = np.random.default_rng(seed).random()
    if len(left) == 1:
        out[left] = float(draw < out[left[0]])
    elif len(left) == 2:
        p, q = out[left]
        x, y = tokens[left].astype(float)
        scale = max(x, y, 1.0)
        cost = lambda s, t: (s + t - p - q) ** 2 + ((s * x + t * y - p * x - q * y) / scale) ** 2
        both = [max(0.0, p + q - 1), min(p, q)]
        expected = [b * cost(1, 1) + (p - b) * cost(1, 0) + (q - b) * cost(0, 1) + (1 - p - q + b) * cost(0, 0) for b in both]
        b = both[int(np.argmin(expected))]
        out[left] = (1, 1) if draw < b else (1, 0) if draw < p else (0, 1) if draw < p + q - b else (0, 0)
    return out


def _seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def _fly(seed: int, level: int, last: bool = False):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "tokens"], kind="stable")
        own = _seed_of(seed, level, *(str(k) for k in key))
        tokens = rows["tokens"].to_numpy()
        p = flight(rows["p"].to_numpy(), tokens, own)
        return rows.assign(p=land(p, tokens, own + 1) if last else p)

    return run


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, fraction: float = FRACTION, alpha: float = ALPHA, seed: int = SEED, units: int = UNITS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id_col, source, tokens, pi, selected) of each unit; a budget of `fraction` of all tokens is shared out."""
    spark = docs.sparkSession
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("bigint")
    # Within, a source has a sign before its name, so that null is none of the names.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"), count.alias("tokens"))
    unit = cut(rows.groupBy("id").agg(F.min("s").alias("s"), F.sum("tokens").alias("tokens")).withColumn("o", F.xxhash64(F.col("id").cast("string"), F.lit(seed))))
    totals = unit.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow(F.greatest("tokens", F.lit(1)).cast("double"), F.lit(float(alpha))))
    else:
        given = spark.createDataFrame([("" if s is None else "=" + s, float(w)) for s, w in weights.items()], "s string, weight double")
        totals = totals.join(F.broadcast(given), "s", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))  # the caller's own rows
    totals = cut(totals.withColumn("buckets", F.ceil(F.col("n") / units).cast("bigint")))
    tokens, most = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("buckets"), F.lit(1))).first()
    of = cut(probabilities(totals, fraction * tokens, fraction).select("s", "pi", "buckets"))
    start = unit.join(maybe_broadcast(of), "s").select("id", "s", "o", "tokens", "pi", F.col("pi").alias("p"), F.pmod(F.xxhash64("o"), "buckets").alias("bucket"))
    schema = start.schema
    decided, open_, level = [], start.where((F.col("p") > 0) & (F.col("p") < 1)), 0
    decided.append(start.where((F.col("p") <= 0) | (F.col("p") >= 1)))
    across = False
    while True:
        by = [F.lit("").alias("s_"), "bucket"] if across else ["s", "bucket"]
        flown = cut(open_.groupBy(*by).applyInPandas(_fly(seed, level), schema))
        decided.append(flown.where("p = 0 or p = 1"))
        open_ = flown.where("p > 0 and p < 1")
        level += 1
        if across or most == 1:
            # Each source has left at most two units; these fly in buckets across sources, until few are left in all.
            across, left = True, open_.count()
            if left <= units:
                break
            most = -(-left // units)
        else:
            most = -(-3 * most // units)  # at most two of a bucket are left
        open_ = open_.withColumn("bucket", F.pmod(F.xxhash64("o", F.lit(level)), F.lit(most).cast("bigint")))
    # The last ones of all are flown and landed together.
    decided.append(open_.groupBy(F.lit(0).alias("all")).applyInPandas(_fly(seed, level + 1, last=True), schema))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    source = F.when(F.col("s") != "", F.substring("s", 2, 2**31 - 1))
    return out.select(F.col("id").alias(id_col), source.alias("source"), "tokens", "pi", (F.col("p") > 0.5).alias("selected"))


def mix(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of docs that sample() selects, their columns as they were."""
    name = free_name(docs, "chosen_id")
    chosen = sample(docs, id_col=id_col, **parameters).where("selected").select(F.col(id_col).alias(name))
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen[name]), "left_semi")
