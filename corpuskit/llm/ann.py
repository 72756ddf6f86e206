"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are hashed into shards of about SHARD. In each, a graph is built over its distinct vectors: a greedy beam
search from the medoid and some random nodes proposes neighbours of each vector, and relaxed pruning keeps those to which no kept
neighbour is nearer, by the factor ALPHA, than the vector itself, so that edges stay few and lead in different directions.
All rows are indexed; the queries are all rows, or those given. A shard's queries stream past its graph, many in step, so that a step
is a few numpy operations: beam search queries each shard, and the nearest of all shards are merged.

Distance is Euclidean. Defined results: rows of null id, or whose vector is null, empty or not finite are left out; vectors are
held against those of their own length alone, each length having its shards; equal vectors are one node, that stands for all their ids; rows
of one id take its least vector; ties go to the least id; an id is never its own neighbour; with fewer than
k others all are given; an empty table gives an empty one. Only the id and vector columns are read; ids are of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut, maybe_broadcast

NEIGHBOURS, SHARD = 10, 8192
DEGREE, BUILD_BEAM, BEAM, ALPHA, ENTRIES = 32, 64, 128, 1.2, 16
#: The query set of op3: ids divisible by this.
EVERY = 50
#: Nodes of a beam that are expanded in one step.
_WIDE = 4


def _distances(vectors: np.ndarray, norms: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of nodes; infinite where the node is -1."""
    dots = np.einsum("brd,bd->br", vectors[ids], queries, optimize=False)
    out = norms[ids] - 2 * dots + np.einsum("bd,bd->b", queries, queries)[:, None]
    out[ids < 0] = np.inf
    return out


def beam_search(vectors: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of each query's best `beam`, nearest first; -1 and infinity where there are fewer."""
    b, n = len(queries), len(vectors)
    ids = np.full((b, beam), -1, dtype=np.int64)
    far = np.full((b, beam), np.inf, dtype=np.float32)
    first = np.broadcast_to(entry[:beam], (b, min(beam, len(entry))))
    ids[:, : first.shape[1]] = first
    far[:, : first.shape[1]] = _distances(vectors, norms, queries, first)
    done = ids < 0
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column is that of node -1
    np.put_along_axis(seen, first, True, axis=1)
    seen[:, n] = True
    live = np.arange(b)
    while len(live):
        todo = np.where(done[live], np.inf, far[live])
        wide = min(_WIDE, beam)
        pick = np.argpartition(todo, wide - 1, axis=1)[:, :wide]
        good = np.isfinite(np.take_along_axis(todo, pick, axis=1))
        open_ = good.any(axis=1)
        live, pick, good = live[open_], pick[open_], good[open_]
        if not len(live):
            break
        row = live[:, None]
        done[row, pick] = True
        nodes = np.where(good, ids[row, pick], -1)
        new = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        new[seen[row, new]] = -1
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[row, new] = True
        d = _distances(vectors, norms, queries[live], new).astype(np.float32)
        all_d = np.concatenate([far[live], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        far[live] = np.take_along_axis(all_d, best, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], new < 0], axis=1), best, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, axis=1)
    return np.where(np.isfinite(far), np.take_along_axis(ids, order, axis=1), -1), far


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` of each point's candidates (nodes, -1 for none; far: squared distances): the nearest, then the nearest to which no kept one is alpha times nearer, and so on."""
    p, c = candidates.shape
    own = vectors[candidates]
    norm = np.einsum("pcd,pcd->pc", own, own)
    between = norm[:, :, None] + norm[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    left = np.where((candidates < 0) | (candidates == points[:, None]), np.inf, far)
    kept = np.full((p, degree), -1, dtype=np.int32)
    every = np.arange(p)
    for j in range(degree):
        at = left.argmin(axis=1)
        some = np.isfinite(left[every, at])
        if not some.any():
            break
        kept[some, j] = candidates[every, at][some]
        left[every, at] = np.inf
        left[(alpha * alpha * between[every, at] <= far) & some[:, None]] = np.inf
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(graph: the out-neighbours of each node, -1 for none; nodes to begin searches at)."""
    n = len(vectors)
    r = np.random.default_rng(seed)
    norms = np.einsum("nd,nd->n", vectors, vectors)
    graph = np.full((n, degree), -1, dtype=np.int32)
    if n > 1:
        some = r.integers(0, n - 1, (n, min(degree // 2, n - 1))).astype(np.int32)
        graph[:, : some.shape[1]] = some + (some >= np.arange(n)[:, None])
    centre = vectors.mean(axis=0)
    entry = np.unique(np.append(r.integers(0, n, min(ENTRIES, n) - 1), int(np.argmin(norms - 2 * vectors @ centre))))
    for by in (1.0, alpha):
        order = r.permutation(n)
        for begin in range(0, n, batch):
            points = order[begin : begin + batch]
            found, far = beam_search(vectors, norms, graph, entry, vectors[points], beam)
            candidates = np.concatenate([found, graph[points]], axis=1)
            far = np.concatenate([far, _distances(vectors, norms, vectors[points], graph[points].astype(np.int64)).astype(np.float32)], axis=1)
            ordered = np.argsort(candidates, axis=1, kind="stable")
            candidates, far = np.take_along_axis(candidates, ordered, axis=1), np.take_along_axis(far, ordered, axis=1)
            candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
            graph[points] = robust_prune(vectors, points, candidates, far, degree, by)
            _add_reverse(vectors, norms, graph, points, degree, by)
    return graph, entry


def _add_reverse(vectors: np.ndarray, norms: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """An edge back to each point from its neighbours; a node with too many edges is pruned."""
    source, slot = np.nonzero(graph[points] >= 0)
    target, origin = graph[points][source, slot], points[source]
    order = np.lexsort((origin, target))
    target, origin = target[order], origin[order]
    there = (graph[target] == origin[:, None]).any(axis=1)
    target, origin = target[~there], origin[~there].astype(np.int32)
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    most = int(count.max())
    extra = np.full((len(nodes), most), -1, dtype=np.int32)
    extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = origin
    both = np.concatenate([graph[nodes], extra], axis=1)
    used = (both >= 0).sum(axis=1)
    fits = used <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
    graph[nodes[fits]] = packed[fits][:, :degree]
    for begin in range(0, int((~fits).sum()), 256):
        own = nodes[~fits][begin : begin + 256]
        wide = packed[~fits][begin : begin + 256].astype(np.int64)
        wide = wide[:, : max(1, int((wide >= 0).sum(axis=1).max()))]
        graph[own] = robust_prune(vectors, own, wide, _distances(vectors, norms, vectors[own], wide).astype(np.float32), degree, alpha)


def search_shard(index: dict, asked: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM, batch: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the neighbour, distance): of each query, the k nearest of a shard's members other than itself, as far as the beam finds them. asked: each query's place among the members, or -1."""
    vectors, graph, node = index["vectors"], index["graph"], index["nodes"]
    norms = np.einsum("nd,nd->n", vectors, vectors)
    by_node = np.argsort(node, kind="stable")  # members are in order of id, so each node's are
    first = np.searchsorted(node[by_node], np.arange(len(vectors) + 1))
    held = np.diff(first)
    rows, near, far = [], [], []
    for begin in range(0, len(queries), batch):
        own, q = asked[begin : begin + batch], queries[begin : begin + batch]
        found, _ = beam_search(vectors, norms, graph, index["entry"], q, max(beam, k + 1))
        found = found[:, : k + 1]  # one of them can be the query itself
        row, col = np.nonzero(found >= 0)
        nodes = found[row, col]
        # Of a node's many equal vectors no more than k + 1 can be among the nearest.
        times = np.minimum(held[nodes], k + 1)
        row, nodes = np.repeat(row, times), np.repeat(nodes, times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        who = by_node[first[nodes] + nth]
        d = np.sqrt(((vectors[nodes].astype(np.float64) - q[row]) ** 2).sum(axis=1))
        other = who != own[row]
        row, who, d = row[other], who[other], d[other]
        order = np.lexsort((who, d, row))
        row, who, d = row[order], who[order], d[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[top] + begin)
        near.append(who[top])
        far.append(d[top])
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, near, far))


def _indexed(members: list, vectors: np.ndarray) -> dict:
    """A shard's graph; members are its ids in order."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    graph, entry = build_graph(distinct)
    return {"members": members, "vectors": distinct, "nodes": node.reshape(-1), "graph": graph, "entry": entry, "place": {m: i for i, m in enumerate(members)}}


def _searched(k: int):
    """A partition is a shard: rows (asks, id, v) of its members in order of id, then of its queries. The graph is built once and the queries go past it batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members, index = [], None
        for batch in batches:
            own, asks = batch[~batch["asks"]], batch[batch["asks"]]
            if len(own):
                members.append(own)
            if not len(asks):
                continue
            if index is None:
                held = pd.concat(members)
                index, members = _indexed(held["id"].tolist(), np.stack(held["v"].to_numpy()).astype(np.float32)), []
            ids = asks["id"].tolist()
            place = np.array([index["place"].get(i, -1) for i in ids])
            row, near, far = search_shard(index, place, np.stack(asks["v"].to_numpy()).astype(np.float32), k)
            kind = asks["id"].dtype
            yield pd.DataFrame({"q": pd.Series([ids[i] for i in row], dtype=kind), "n": pd.Series([index["members"][i] for i in near], dtype=kind), "d": far})

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dims) of rows that have an id and a finite vector, one an id."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and size(v) > 0")
    # forall() of a null element is null, so such vectors go too.
    own = own.where(F.forall("v", lambda x: (~F.isnan(x)) & (F.abs(x) < float("inf")))).groupBy("id").agg(F.min("v").alias("v"))
    return own.withColumn("dims", F.size("v"))


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEIGHBOURS, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, rank, neighbour, distance): the k nearest other ids of each query, rank 1 first. queries has the columns of vectors; without it, all rows are queries."""
    own = cut(_usable(vectors, id_col, vector_col))
    asked = own if queries is None else cut(_usable(queries, id_col, vector_col))
    lengths = own.groupBy("dims").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    earlier = Window.orderBy("dims").rowsBetween(Window.unboundedPreceding, -1)  # a row a length
    lengths = cut(lengths.withColumn("base", F.coalesce(F.sum("shards").over(earlier), F.lit(0)).cast("int")))
    total = lengths.agg(F.sum("shards")).first()[0] or 1
    lengths = maybe_broadcast(lengths)
    place = F.col("base") + F.pmod(F.xxhash64("id"), F.col("shards").cast("bigint")).cast("int")
    members = own.join(lengths, "dims").select(place.alias("shard"), F.lit(False).alias("asks"), "id", "v")
    # Every query goes to every shard of its length, as the method has it.
    asks = asked.join(lengths, "dims").select(F.explode(F.sequence(F.col("base"), F.col("base") + F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    rows = members.unionByName(asks).repartitionById(total, "shard").sortWithinPartitions("asks", "id")
    kind = own.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(_searched(k), f"q {kind}, n {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))
    nearest = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return nearest.select(F.col("q").alias(id_col), "rank", F.col("n").alias("neighbour"), F.col("d").alias("distance"))
