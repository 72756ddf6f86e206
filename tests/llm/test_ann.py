from __future__ import annotations

import numpy as np

from corpuskit.llm import ann


def exact(ids, vectors, k):
    d = np.sqrt(((vectors[:, None, :].astype(float) - vectors[None]) ** 2).sum(axis=2))
    d[ids[:, None] == ids[None]] = np.inf
    return {int(i): [(int(ids[j]), float(row[j])) for j in sorted(range(len(ids)), key=lambda j: (row[j], ids[j]))[:k] if np.isfinite(row[j])] for i, row in zip(ids, d, strict=True)}


def clustered(n, dims, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((10, dims)) * 2
    return (centres[r.integers(0, 10, n)] + r.standard_normal((n, dims))).astype(np.float32)


def recall(got, want):
    return np.mean([len({j for j, _ in got[i]} & {j for j, _ in w}) / len(w) for i, w in want.items() if w])


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append((r.neighbour, r.distance))
    return out


def test_prune_keeps_diverse_edges():
    vectors = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3]], dtype=np.float32)
    candidates, point = np.array([[1, 2, 3, -1, 0]]), np.array([0])
    far = np.array([[1, 1.21, 9, np.inf, 0]], dtype=np.float32)
    assert ann.robust_prune(vectors, point, candidates, far, 4, 1.2).tolist() == [[1, 3, -1, -1]]


def test_recall_against_brute_force(spark):
    vectors = clustered(1500, 32)
    df = spark.createDataFrame([(i, v.tolist(), 1, "s") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, id int, shard string")
    got, want = collect(ann.neighbours(df, shard=600)), exact(np.arange(1500), vectors, 10)
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    assert recall(got, want) >= 0.95
    some = collect(ann.neighbours(df, df.where("vec_id % 50 = 0"), shard=600))
    assert some == {i: got[i] for i in range(0, 1500, 50)}
    for i in range(0, 1500, 97):
        assert all(abs(d - np.sqrt(((vectors[i].astype(float) - vectors[j]) ** 2).sum())) < 1e-5 for j, d in got[i])


def test_ties_copies_and_few_rows(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((30, 8)).astype(np.float32)
    vectors = np.concatenate([base, np.repeat(base[:2], 20, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got, want = collect(ann.neighbours(df, k=5)), exact(np.arange(len(vectors)), vectors, 5)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert collect(ann.neighbours(df.where("vec_id < 3"), k=5)).keys() == {0, 1, 2}
    assert ann.neighbours(df.where("vec_id < 1"), k=5).count() == 0


def test_nulls_odd_vectors_repeats_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0]), (3, None), (None, [1.0, 2.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, []), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rows += [(9, [3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert collect(ann.neighbours(df)) == {1: [(2, 1.0)], 2: [(1, 1.0)], 4: [(9, 2.0)], 9: [(4, 2.0)]}
    named = df.selectExpr("'id ' || vec_id AS vec_id", "embedding")
    assert collect(ann.neighbours(named)) == {f"id {a}": [(f"id {b}", d)] for a, b, d in ((1, 2, 1.0), (2, 1, 1.0), (4, 9, 2.0), (9, 4, 2.0))}
    assert ann.neighbours(df.limit(0)).count() == 0
