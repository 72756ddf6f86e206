"""Best-fit packing of documents into sequences of CAPACITY tokens by a grouping genetic algorithm.

A document of more tokens than a sequence holds fills sequences with its first pieces; its last piece is packed like a
short document. Pieces are hashed into blocks of about ITEMS, and each block is packed on ISLANDS of their own populations. A
packing's genes are its bins. Crossover injects whole, well-filled bins of one parent into the other, removes the bins there that
hold a document twice, puts displaced documents in place of smaller ones where they fill a bin better, and the rest where they fit best; mutation dissolves some of the emptiest bins. After each
epoch the islands of a block, which run as separate tasks, send their best packing to the next island. The best of all is kept. A block whose bins
can't be fewer is done.

Tokens are counted as runs of non-space characters. Defined results: a text without tokens, or null, is in no bin (bin is null);
repeated rows are packed each; equal sizes are taken in order of id; a very long text is counted whole; an empty table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._spark import cut

CAPACITY, ITEMS, ISLANDS, EPOCHS, MOST_TASKS = 2048, 4096, 2, 4, 20_000
POPULATION, OFFSPRING, WELL_FILLED = 6, 16, 0.98


def best_fit(sizes: list[int], items: list[int], bins: np.ndarray, room: dict[int, int], capacity: int) -> None:
    """Put the items, in this order, each into the bin of least room that holds it, else a new one; bins and room change."""
    free = sorted((r, b) for b, r in room.items() if r > 0)
    following = max(room, default=-1) + 1
    for i in items:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, following
            following += 1
        bins[i] = b
        room[b] = r - size
        if r > size:
            insort(free, (r - size, b))


def _rooms(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> dict[int, int]:
    used = np.bincount(bins[bins >= 0], weights=sizes[bins >= 0])
    held = np.bincount(bins[bins >= 0])
    return {int(b): int(capacity - used[b]) for b in np.flatnonzero(held)}


def _closed(bins: np.ndarray) -> np.ndarray:
    """The same packing with bins numbered from 0."""
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: it rewards few bins, and full ones beside empty ones."""
    if not len(bins):
        return 1.0
    return float(np.mean((np.bincount(bins, weights=sizes) / capacity) ** 2))


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, r: np.random.Generator) -> np.ndarray:
    """a with some of b's well-filled bins."""
    fill = np.bincount(b, weights=sizes) / capacity
    good = np.flatnonzero(fill >= min(WELL_FILLED, np.median(fill)))
    chosen = r.choice(good, max(1, int(len(good) * r.uniform(0.1, 0.4))), replace=False)
    injected = np.isin(b, chosen)
    doubled = np.unique(a[injected])
    child = a.copy()
    displaced = np.isin(a, doubled) & ~injected
    child[injected] = b[injected] + (a.max() + 1)
    return _repaired(sizes, child, displaced, capacity)


def mutate(sizes: np.ndarray, a: np.ndarray, capacity: int, r: np.random.Generator) -> np.ndarray:
    """a with some of its emptiest bins dissolved."""
    used = np.bincount(a, weights=sizes)
    worst = np.argsort(used + r.random(len(used)) * capacity * 0.2)[: max(2, len(used) // 20)]
    return _repaired(sizes, a.copy(), np.isin(a, worst), capacity)


def _repaired(sizes: np.ndarray, child: np.ndarray, displaced: np.ndarray, capacity: int) -> np.ndarray:
    child[displaced] = -1
    room = _rooms(sizes, child, capacity)
    items = np.flatnonzero(displaced)
    order = _swapped(sizes.tolist(), items[np.argsort(-sizes[items], kind="stable")].tolist(), child, room)
    best_fit(sizes.tolist(), order, child, room, capacity)
    return _closed(child)


def _swapped(sizes: list[int], items: list[int], bins: np.ndarray, room: dict[int, int]) -> list[int]:
    """The displaced items (largest first), after some went into bins with room in place of smaller ones, which are displaced instead: one for one, each as large as fits, or two for one."""
    free = sorted((sizes[i], i) for i in items)
    held: dict[int, list[int]] = {}
    open_ = {b for b, r in room.items() if r > 0}
    for i in np.flatnonzero(np.isin(bins, list(open_))).tolist():
        held.setdefault(int(bins[i]), []).append(i)
    for b in sorted(held, key=lambda b: (room[b], b)):
        for i in sorted(held[b], key=lambda i: (sizes[i], i)):
            if not room[b] or not free:
                break
            most = sizes[i] + room[b]
            at = bisect_left(free, (most + 1, -1)) - 1
            if at < 0:
                continue
            one, pair = free[at], None
            if one[0] < most and len(free) > 1:  # two that fill it wholly
                low, high = 0, at
                while low < high:
                    both = free[low][0] + free[high][0]
                    if both == most:
                        pair = (free[low], free[high])
                        break
                    low, high = (low + 1, high) if both < most else (low, high - 1)
            taken = list(pair) if pair else [one] if one[0] > sizes[i] else []
            if not taken:
                continue
            for x in taken:
                free.pop(bisect_left(free, x))
                bins[x[1]] = b
            bins[i] = -1
            insort(free, (sizes[i], i))
            room[b] = most - sum(x[0] for x in taken)
    return [i for _, i in sorted(free, key=lambda x: (-x[0], x[1]))]


def first_packings(sizes: np.ndarray, capacity: int, r: np.random.Generator, n: int) -> list[np.ndarray]:
    """Best-fit decreasing, then best fit in orders that are more and more loosely so."""
    out = []
    for j in range(n):
        bins = np.full(len(sizes), -1, dtype=np.int64)
        order = np.argsort(-sizes * (1 + r.uniform(-0.15, 0.15, len(sizes)) * j), kind="stable")
        best_fit(sizes.tolist(), order.tolist(), bins, {}, capacity)
        out.append(_closed(bins))
    return out


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: what all sizes ask for, or those of over half or over a third of the capacity."""
    half, third = (sizes * 2 > capacity).sum(), ((sizes * 3 > capacity) & (sizes * 2 <= capacity)).sum()
    wide = sizes[sizes * 2 > capacity]
    beside = int((wide * 3 < 2 * capacity).sum())  # these may have room for one of over a third
    return max(-(-int(sizes.sum()) // capacity), int(half + max(0, -(-(int(third) - beside) // 2))))


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, r: np.random.Generator, offspring: int = OFFSPRING) -> list[np.ndarray]:
    """The population after some offspring, best first; each replaces the worst if it is better. A packing that can't be bettered ends it."""
    ranked = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    least = fewest(sizes, capacity)
    for step in range(offspring):
        if not len(sizes) or ranked[0][2].max() + 1 <= least:
            break
        i, j = sorted(r.choice(len(ranked), 2, replace=len(ranked) < 2))
        child = crossover(sizes, ranked[i][2], ranked[j][2], capacity, r)
        if step % 3 == 2:
            child = mutate(sizes, child, capacity, r)
        value = fitness(sizes, child, capacity)
        if value > ranked[-1][0]:
            ranked[-1] = (value, len(population) + step, child)
            ranked.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, _, p in ranked]


def _island(capacity: int, islands: int, epoch: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        r = np.random.default_rng([seed, block & 0x7FFFFFFF, island, epoch])
        rows = rows.sort_values("migrant")
        sizes = np.frombuffer(rows["sizes"].dropna().iloc[0], dtype=np.int32)
        if epoch == 0:
            population = first_packings(sizes, capacity, r, POPULATION)[:: 1 if island == 0 else -1]
        else:
            population = [x for b in rows["packings"] for x in np.frombuffer(b, dtype=np.int32).reshape(-1, len(sizes))]
        population = evolve(sizes, population, capacity, r)[:POPULATION]
        out = [(block, island, False, sizes.tobytes(), np.stack(population).tobytes())]
        if islands > 1:
            out.append((block, (island + 1) % islands, True, None, population[0].tobytes()))
        return pd.DataFrame(out, columns=["block", "island", "migrant", "sizes", "packings"])

    return run


def _best(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.frombuffer(rows["sizes"].dropna().iloc[0], dtype=np.int32)
        each = [np.frombuffer(b, dtype=np.int32).reshape(-1, len(sizes))[0] for b in rows.sort_values(["island", "migrant"])["packings"]]
        best = max(each, key=lambda p: fitness(sizes, p, capacity))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "bins": [best.tolist()]})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, first_token, tokens, block, bin): which tokens of a document are in which sequence; (block, bin) names it."""
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0))
    # Rows of one id and length are counted and then told apart by number, so that no id's rows are all in one block.
    sized = docs.select(F.col(id_col).alias("id"), count.cast("int").alias("n")).groupBy("id", "n").agg(F.count("*").alias("times"))
    sized = cut(sized.select("id", "n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")))
    pieces = sized.where("n > 0").select("id", "n", "copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))
    blocks = max(1, -(-pieces.count() // items))
    block = F.pmod(F.xxhash64(F.col("id").cast("string"), "piece", "copy", F.lit(seed)), F.lit(blocks).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "id", "piece")))
    held = cut(pieces.groupBy(block.alias("block")).agg(ordered.alias("m")).withColumn("full", F.size(F.filter("m", lambda x: x["neg"] == -capacity))))
    to_bytes = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, dtype=np.int32).tobytes()), "binary")
    rest = F.transform(F.filter("m", lambda x: x["neg"] > -capacity), lambda x: -x["neg"])
    each = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = held.where("size(m) > full").select("block", each, F.lit(False).alias("migrant"), to_bytes(rest).alias("sizes"), F.lit(None).cast("binary").alias("packings"))
    for epoch in range(epochs):
        # So many partitions that each island has a task of its own; left to itself, Spark would put these small rows in one.
        state = state.repartition(min(blocks * islands, MOST_TASKS), "block", "island").groupBy("block", "island").applyInPandas(_island(capacity, islands, epoch, seed), "block bigint, island int, migrant boolean, sizes binary, packings binary")
    chosen = state.groupBy("block").applyInPandas(_best(capacity), "block bigint, bins array<int>")
    placed = held.join(chosen, "block", "left").select("block", "full", "bins", F.posexplode("m").alias("i", "x"))
    # Full pieces come first in m; each is a sequence by itself, numbered below 0.
    bin_ = F.when(F.col("i") < F.col("full"), -1 - F.col("i")).otherwise(F.get("bins", F.col("i") - F.col("full")))
    packed = placed.select(F.col("x.id").alias("id"), F.col("x.piece").alias("piece"), (-F.col("x.neg")).alias("size"), "block", bin_.alias("bin"))
    none = sized.where("n = 0").select("id", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("int").alias("bin"))
    out = packed.unionByName(none)
    return out.select(F.col("id").alias(id_col), "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.col("size").alias("tokens"), "block", "bin")
