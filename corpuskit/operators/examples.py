"""Token streams and training examples as array expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpuskit.config import SEED, Sentinels
from corpuskit.functions import text as T
from corpuskit.operators.dedup import checkpointed
from corpuskit.operators.mix import ranked


def filled_in_middle(ids: Column, key: Column, rate: float, sentinels: Sentinels, spm_rate: float = 0.5, seed: int = SEED) -> Column:
    """ids, or with probability `rate` their three parts reordered around sentinels, so that the middle comes last.

    The cuts are a in 1..n-2 and b in a+1..n-1. With probability spm_rate the suffix leads. Fewer than four ids stay.
    """
    n = F.size(ids)
    at = lambda purpose: T.draw(key, purpose, seed)
    a = F.lit(1) + F.floor(at("fim_a") * (n - 2)).cast("int")
    b = a + 1 + F.floor(at("fim_b") * (n - 1 - a)).cast("int")
    prefix, middle, suffix = F.slice(ids, F.lit(1), a), F.slice(ids, a + 1, b - a), F.slice(ids, b + 1, n - b)
    mark = lambda x: F.array(F.lit(x))
    pre, mid, suf = mark(sentinels.prefix), mark(sentinels.middle), mark(sentinels.suffix)
    suffix_first = F.concat(pre, suf, suffix, mid, prefix, middle)
    prefix_first = F.concat(pre, prefix, suf, suffix, mid, middle)
    moved = F.when(at("fim_order") < spm_rate, suffix_first).otherwise(prefix_first)
    return F.when((n >= 4) & (at("fim") < rate), moved).otherwise(ids)


def with_end(ids: Column, eos: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos)))


@F.arrow_udf(BinaryType())
def _uint16(ids: pa.Array) -> pa.Array:
    values = ids.flatten().to_numpy(zero_copy_only=False)
    if len(values) and not 0 <= values.min() <= values.max() < 1 << 16:
        raise ValueError("ids of two bytes are below 65,536")
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64) * 2)
    held = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<u2"))])
    return pc.if_else(ids.is_valid(), held, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def stream(docs: DataFrame, ids: str = "ids", order: str = "ord") -> DataFrame:
    """(order, first, n, data): the documents' ids as one stream of two bytes each. first is a document's place in the stream, so that rows in order of it, data after data, are the stream, and any place can be looked up.

    What is sized is written to the checkpoint folder first, two bytes an id, as numbering goes over it three times and the ids may cost an encoding.
    """
    sized = checkpointed(docs.select(order, F.size(ids).cast("bigint").alias("n"), _uint16(ids).alias("data")))
    return ranked(sized, order, "first", weight="n").select(order, "first", "n", "data")


def masked_example(ids: Column, prompt_len: Column, block: int, eos: int) -> Column:
    """Struct (x, y) of `block` places each: y is x one place on, -1 over the prompt and behind the one end mark; null if the ids don't fit."""
    n = F.size(ids) + 1
    padded = F.concat(ids, F.array_repeat(F.lit(eos), F.lit(block + 1) - F.size(ids)))
    after = F.slice(padded, 2, block)
    y = F.transform(after, lambda v, i: F.when((i < prompt_len - 1) | (i >= n - 1), F.lit(-1)).otherwise(v))
    return F.when(n <= block + 1, F.struct(F.slice(padded, 1, block).alias("x"), y.alias("y")))


def pair_batches(pairs: DataFrame, key: str = "ord") -> DataFrame:
    """A batch's pairs as its chosen rows, then its rejected ones: (batch_id, row, side, ids, prompt_len)."""
    n = F.max("place").over(_of_batch()) + 1
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("e"), F.lit(0).alias("half")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("e"), F.lit(1).alias("half"))))
    out = pairs.withColumn("__n", n).select("batch_id", key, "place", "__n", sides.alias("s"))
    return out.select("batch_id", (F.col("s.half") * F.col("__n") + F.col("place")).alias("row"), F.col("s.side").alias("side"), key, F.col("s.e.ids").alias("ids"), F.col("s.e.prompt_len").alias("prompt_len"))


def _of_batch():
    from pyspark.sql import Window

    return Window.partitionBy("batch_id")


def windows(docs: DataFrame, n: int, block: int, seed: int = SEED, ids: str = "ids", key: str = "ord") -> DataFrame:
    """n random windows of each stream: x, and y one place on. Offsets are uniform from 0 to below size - block - 1, as the last valid one is left out."""
    last = F.size(ids) - block - 1
    out = docs.where(last > 0).select(key, ids, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    at = F.floor(T.draw(F.concat_ws("/", F.col(key).cast("string"), F.col("draw").cast("string")), "window", seed) * last).cast("int")
    out = out.withColumn("offset", at)
    return out.select(key, "draw", "offset", F.slice(ids, F.col("offset") + 1, block).alias("x"), F.slice(ids, F.col("offset") + 2, block).alias("y"))
