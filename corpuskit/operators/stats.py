"""Reports over filters, outcomes and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.numeric import decision, pass_at_k
from corpuskit.functions.text import strip


def source_stats(gated: DataFrame) -> DataFrame:
    """By source, of rows (source, response, code, drop_reason): how many were seen before the cap was met, and kept, characters of those, blank ends of responses left out, and the part of them that is prose."""
    keep = F.col("drop_reason").isNull()
    chars = lambda c: F.coalesce(F.sum(F.when(keep, F.length(c))), F.lit(0))
    seen = F.count_if(keep | (F.col("drop_reason") != "source_cap"))
    stats = gated.groupBy("source").agg(seen.alias("seen"), F.count_if(keep).alias("kept"), chars(strip(F.col("response"))).alias("response_chars"), chars("code").alias("code_chars"))
    return stats.withColumn("prose", F.when(F.col("response_chars") > 0, F.lit(1.0) - F.col("code_chars") / F.col("response_chars")).otherwise(F.lit(0.0)))


def drops_by_reason(gated: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """A row a source, a column a reason."""
    return gated.groupBy("source").agg(*(F.count_if(F.col("drop_reason") == r).alias(r) for r in reasons))


def filter_report(gated: DataFrame) -> DataFrame:
    """By source, and for all as TOTAL: seen before the source's cap was met, kept, leaks and the share kept."""
    keep, seen = F.count_if(F.col("drop_reason").isNull()), F.count_if(F.coalesce(F.col("drop_reason") != "source_cap", F.lit(True)))
    out = gated.rollup("source").agg(seen.alias("seen"), keep.alias("kept"), F.count_if(F.col("drop_reason") == "benchmark_leak").alias("leaks"), (keep / F.greatest(seen, F.lit(1))).alias("share"), F.grouping("source").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "seen", "kept", "leaks", "share")


def top_reasons(gated: DataFrame, n: int = 3) -> DataFrame:
    counts = gated.where("drop_reason is not null").groupBy("source", "drop_reason").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("cnt"), "drop_reason"))
    return counts.withColumn("place", rank).where(F.col("place") <= n)


def histogram(records: DataFrame, column: str = "outcome") -> DataFrame:
    """(column, cnt, freq), most frequent first."""
    out = records.groupBy(column).agg(F.count("*").alias("cnt"))
    return out.withColumn("freq", F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).orderBy(F.desc("cnt"), column)


def per_task(records: DataFrame, dedupe: bool = False) -> DataFrame:
    if dedupe:
        records = records.dropDuplicates(["task_id", "sample"])
    return records.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "PASS").alias("c"))


def summary(records: DataFrame, ks: Sequence[int] = (1, 5, 10), by: Sequence[str] = (), complete_only: bool = False) -> DataFrame:
    """One row (for each group of `by`): tasks, samples, the mean chance to pass for each k that some task has samples for, rates, and the outcomes as a map.

    complete_only leaves tasks of fewer than k samples out of pass_at_k, for which it would be 1 without a pass.
    """
    keys = list(by)
    tasks = records.groupBy(*keys, "task_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "PASS").alias("c"), F.count_if("parses").alias("parsed"))
    mean = lambda k: F.avg(F.when(F.lit(not complete_only) | (F.col("n") >= k), pass_at_k(F.col("n"), F.col("c"), k)))
    measured = [F.when(F.max("n") >= k, mean(k)).alias(f"pass_at_{k}") for k in ks]
    incomplete = [F.count_if(F.col("n") < max(ks)).alias("n_incomplete")]
    out = tasks.groupBy(*keys).agg(F.count("*").alias("tasks"), F.sum("n").alias("samples"), *measured, F.count_if(F.col("c") > 0).alias("solved"), (F.sum("parsed") / F.sum("n")).alias("parse_rate"), *incomplete)
    shares = records.groupBy(*keys, "outcome").agg(F.count("*").alias("cnt"))
    shares = shares.withColumn("freq", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys)))
    maps = shares.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "freq")))).alias("outcomes"))
    return out.join(maps, keys) if keys else out.crossJoin(maps)


def probe_report(records: DataFrame, pool_size: int, seconds: float | None = None) -> DataFrame:
    """One row: of the tasks probed, the share with a pass (the yield of rejection tuning), with both outcomes (of pairs), with passes alone and with none; what that and the seconds it took come to over a pool of that size; and the decision."""
    tasks = per_task(records)
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda which: F.count_if(which) / n
    c, all_ = F.col("c"), F.col("n")
    out = tasks.agg(F.count("*").alias("tasks"), share(c > 0).alias("rft_yield"), share((c > 0) & (c < all_)).alias("pair_yield"), share(c == all_).alias("all_pass"), share(c == 0).alias("all_fail"))
    took = F.lit(seconds).cast("double")
    out = out.withColumn("projected_pairs", F.col("pair_yield") * pool_size).withColumn("seconds", took).withColumn("projected_hours", took / F.greatest("tasks", F.lit(1)) * pool_size / 3600)
    return out.withColumn("decision", decision(F.col("rft_yield"), F.col("projected_pairs")))


def fit_report(df: DataFrame, fits: Column) -> DataFrame:
    kept = F.count_if(fits)
    return df.agg(kept.alias("kept"), (F.count("*") - kept).alias("dropped"), (F.lit(100.0) * (F.count("*") - kept) / F.greatest(F.count("*"), F.lit(1))).alias("dropped_pct"))


def supervised_fraction(examples: DataFrame, block: int, first: int = 2000, order: str = "ord") -> DataFrame:
    """What part of the places of the first examples (ids, prompt_len) is trained on."""
    return examples.orderBy(order).limit(first).agg((F.sum(F.size("ids") - F.col("prompt_len") + 1) / (F.count("*") * block)).alias("supervised"))


def mean_of_batches(rows: DataFrame, columns: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """The mean over batches of each batch's mean."""
    return rows.groupBy(batch).agg(*(F.avg(c).alias(c) for c in columns)).agg(*(F.avg(c).alias(c) for c in columns))
