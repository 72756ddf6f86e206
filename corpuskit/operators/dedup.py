"""First-wins deduplication, benchmark leaks and the joins that lookups amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T


def first_of_each(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row in order of each group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder. A local session that names none, as in tests, gets one of this machine; a cluster's is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpuskit-"))
    return df.checkpoint()


def capped_first_wins(rows: DataFrame, cap: int | None, sources: list[str]) -> DataFrame:
    """rows (source, ord, shape, leak) with drop_reason, as if they were gone through one by one, sources in the order given.

    A row is kept if its source has kept fewer than cap rows (None or 0: any number), no earlier row of its shape was kept, and it
    doesn't leak; only kept rows register their shape. A row of null shape is no candidate: it has no reason but that it can come behind its source's
    last kept row. A source that isn't in the order given, or null, has the reason "unknown_source".

    Without caps the first row of each shape that doesn't leak is kept, by one aggregate over (source, ord). Each source whose cap binds then
    loses what comes behind its last kept row, the first such source first, and the aggregate is made again without that.
    """
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source")) if sources else F.lit(None).cast("bigint")
    rows = checkpointed(rows.withColumn("__source", F.nullif(place, F.lit(0).cast("bigint"))))
    last: dict[int, object] = {}
    fresh = rows.where(F.col("shape").isNotNull() & ~F.col("leak") & F.col("__source").isNotNull()).select("shape", "ord", "__source")
    while True:
        first = fresh.groupBy("shape").agg(F.min(F.struct("__source", "ord")).alias("__first"))
        if not cap:
            break
        counts = first.groupBy("__first.__source").agg(F.count("*").alias("n")).where(F.col("n") >= cap).collect()  # a row a source
        met = sorted(r["__source"] for r in counts if r["__source"] not in last)
        if not met:
            break
        own = first.where(F.col("__first.__source") == met[0]).select("__first.ord")
        last[met[0]] = own.orderBy("ord").limit(cap).agg(F.max("ord")).first()[0]
        fresh = fresh.where((F.col("__source") != met[0]) | (F.col("ord") <= F.lit(last[met[0]])))
    behind = F.lit(False)
    for source, at in last.items():
        behind = behind | ((F.col("__source") == source) & (F.col("ord") > F.lit(at)))
    # Rows without a shape would all be one key of the join.
    none = rows.where("shape is null").withColumn("__first", F.lit(None).cast(first.schema["__first"].dataType))
    marked = rows.where("shape is not null").join(first, "shape", "left").unionByName(none)
    reason = (
        F.when(F.col("__source").isNull(), "unknown_source")
        .when(behind, "source_cap")
        .when(F.col("__first") < F.struct("__source", "ord"), "near_duplicate")
        .when(F.col("shape").isNotNull() & F.col("leak"), "benchmark_leak")
    )
    return marked.withColumn("drop_reason", reason).drop("__source", "__first")


def benchmark_index(tasks: DataFrame) -> DataFrame:
    """(entry_point, words) of tasks (entry_point, prompt)."""
    return tasks.select("entry_point", T.words(T.bare_task(F.col("prompt"))).alias("bench_words"))


def leaks(rows: DataFrame, index: DataFrame, key: str, prompt: str = "prompt", code: str = "code", threshold: float = 0.7, few: int = 2_000) -> DataFrame:
    """(key, best_ratio) of rows that define a benchmark's function and restate one of its problems: an equi-join on the name, then a test of the overlap of words.

    At most `few` rows or problems meet all of the other side; of more than that on both sides only those that candidates() names are tested.
    """
    named = rows.select(key, T.words(F.col(prompt)).alias("w"), F.explode(F.array_distinct(T.def_names(F.col(code)))).alias("entry_point"))
    # The smaller side is sent to the other, so that few names don't put all pairs in few tasks.
    if index.limit(few + 1).count() <= few:
        both = named.join(F.broadcast(index), "entry_point")
    elif threshold <= 0 or rows.limit(few + 1).count() <= few:
        both = index.join(F.broadcast(named), "entry_point")
    else:
        named = checkpointed(named.withColumn("__set", _set_of("w")))
        ours, theirs = _numbered_sets(named.select("entry_point", "w", "__set"), "__a"), _numbered_sets(index.select("entry_point", F.col("bench_words").alias("w"), _set_of("bench_words").alias("__set")), "__b")
        near = candidates(ours, theirs, threshold).join(ours, "__a").join(theirs.select("__b", F.col("w").alias("bench_words")), "__b")
        hit = near.withColumn("ratio", T.containment(F.col("w"), F.col("bench_words"))).where(F.col("ratio") >= threshold)
        best = hit.groupBy("entry_point", "__set").agg(F.max("ratio").alias("ratio"))
        return named.join(best, ["entry_point", "__set"]).groupBy(key).agg(F.max("ratio").alias("best_ratio"))
    hit = both.withColumn("ratio", T.containment(F.col("w"), F.col("bench_words"))).where(F.col("ratio") >= threshold)
    return hit.groupBy(key).agg(F.max("ratio").alias("best_ratio"))


def _set_of(words: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.array_sort(words)), 256)


def _numbered_sets(sets: DataFrame, name: str) -> DataFrame:
    """Each name's distinct sets of words (entry_point, w, __set) once, numbered."""
    return checkpointed(sets.where((F.size("w") > 0) & F.col("entry_point").isNotNull()).dropDuplicates(["entry_point", "__set"]).withColumn(name, F.monotonically_increasing_id()))


def candidates(ours: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """(__a, __b) of sets (entry_point, w, __a) and (entry_point, w, __b) of a name that can share the threshold's part of the smaller one's words, among others.

    Of a set of n words, of which c must be shared, any n - c + 1 hold a shared one. The rarest are asked, in one order for both sides, so that few sets meet.
    """
    seen = theirs.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("seen"))

    def rarest_first(sets: DataFrame, name: str) -> DataFrame:
        each = sets.select("entry_point", name, F.explode("w").alias("word")).join(seen, "word", "left")
        of = each.groupBy("entry_point", name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word")))["word"].alias("w"))
        return checkpointed(of.withColumn(f"{name}n", F.size("w")))

    a, b = rarest_first(ours, "__a"), rarest_first(theirs, "__b")
    all_of = lambda df, n: df.select("entry_point", n, f"{n}n", F.explode("w").alias("word"))
    # A little less is asked than the product says, as that is rounded.
    rare_of = lambda df, n: all_of(df.withColumn("w", F.slice("w", F.lit(1), F.col(f"{n}n") + 1 - F.greatest(F.lit(1), F.ceil(F.col(f"{n}n") * threshold - 1e-6)).cast("int"))), n)
    within = rare_of(a, "__a").join(all_of(b, "__b"), ["entry_point", "word"]).where("__an <= __bn")
    around = all_of(a, "__a").join(rare_of(b, "__b"), ["entry_point", "word"]).where("__an > __bn")
    return within.select("__a", "__b").unionByName(around.select("__a", "__b")).distinct()


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def pool(*parts: DataFrame) -> DataFrame:
    """The parts after one another: pool_rank says which part a row is of."""
    out = parts[0].withColumn("pool_rank", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("pool_rank", F.lit(i)))
    return out
