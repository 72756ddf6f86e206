from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import sharding


@pytest.mark.parametrize("kind", ["uniform", "skewed", "ties", "one"])
def test_splitters_are_those_of_brute_force_within_tolerance(spark, kind):
    r = np.random.default_rng(1)
    keys = {"uniform": r.integers(-(2**62), 2**62, 2000), "skewed": (r.random(2000) ** 12 * 2**60).astype(np.int64), "ties": r.integers(0, 9, 2000), "one": np.full(2000, 5)}[kind]
    sizes = r.integers(0, 1000, 2000)
    sized = spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist(), strict=True)), "k bigint, n bigint").repartition(5)
    for shards, tolerance in ((7, 0.01), (16, 0.0)):
        found = sharding.splitters(sized, shards, tolerance)
        assert (np.diff(found) >= 0).all() and len(found) == shards - 1
        cuts = np.append(np.unique(keys), keys.max() + 1)
        below = np.array([sizes[keys < c].sum() for c in cuts])
        for j, s in enumerate(found, 1):
            target = sizes.sum() * j // shards
            best = np.abs(below - target).min()
            assert abs(sizes[keys < s].sum() - target) <= max(best, tolerance * sizes.sum() / shards)


def test_shards_are_ranges_sorted_and_whole(spark):
    r = np.random.default_rng(2)
    rows = [(i, "x" * int(n), 1) for i, n in enumerate(r.integers(0, 400, 1000))] + [(None, "é" * 10, 1), (5, None, 1), (6, "x" * 9000, 1), (6, "x" * 9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    out = sharding.shard(docs, sharding.hash_key("doc_id"), shards=6)
    assert out.columns == ["doc_id", "text", "shard_", "sort_key", "n_bytes", "shard"] and out.rdd.getNumPartitions() == 6
    parts = out.select("*", F.spark_partition_id().alias("p")).collect()
    assert sorted((x.doc_id or -1, x.text or "") for x in parts) == sorted((a or -1, b or "") for a, b, _ in rows)
    last = -(2**63) - 1
    sizes = []
    for s in range(6):
        own = [x for x in parts if x.shard == s]
        keys = [x.sort_key for x in own]
        assert keys == sorted(keys) and keys[0] > last and len({x.p for x in own}) == 1
        last = keys[-1]
        sizes.append(sum(x.n_bytes for x in own))
    assert {x.n_bytes for x in parts if x.doc_id is None} == {20}
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 6 + 2 * 18_000


def test_number_of_shards_follows_bytes_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(100)], "doc_id bigint, text string")
    assert sharding.shard(docs, F.col("doc_id"), shard_bytes=2500).agg(F.max("shard")).first()[0] == 3
    assert sharding.shard(docs.limit(0), F.col("doc_id")).count() == 0
    named = docs.withColumnRenamed("text", "n_bytes")
    assert sharding.shard(named, F.col("doc_id"), text_col="n_bytes", shards=2).agg(F.sum("n_bytes")).first()[0] == 10_000


@pytest.mark.parametrize("low,high", [(-(2**63), 2**63 - 2), (5, 6), (-3, 4)])
def test_keys_of_the_whole_range(spark, low, high):
    r = np.random.default_rng(3)
    keys = np.append(r.integers(low, high, 3000), [low, high])
    sized = spark.createDataFrame([(int(k), 1) for k in keys], "k bigint, n bigint")
    found = sharding.splitters(sized, 5, 0.0)
    for j, s in enumerate(found, 1):
        want = np.abs(np.array([(keys < c).sum() for c in np.append(np.unique(keys), high + 1)]) - len(keys) * j // 5).min()
        assert abs((keys < s).sum() - len(keys) * j // 5) == want


def test_a_million_boundaries(spark, monkeypatch):
    """Many boundaries cost arrays, not Python numbers; the counts are made here, as the driver's part is what is measured."""
    keys = np.sort(np.random.default_rng(5).integers(0, 2**60, 3_000_000))
    monkeypatch.setattr(sharding, "bytes_below", lambda _, probes: np.searchsorted(keys, probes).astype(np.int64))
    sized = spark.createDataFrame([(int(keys[0]), len(keys)), (int(keys[-1]), 0)], "k bigint, n bigint")
    tracemalloc.start()
    began = time.perf_counter()
    found = sharding.splitters(sized, 1_000_000, 1.0)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 999_999 and (np.abs(np.searchsorted(keys, found) - 3 * np.arange(1, 1_000_000)) <= 3).all()
    assert took < 60 and most < 500e6
