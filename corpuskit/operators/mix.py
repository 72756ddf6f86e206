"""Mixing by document weights, token accounting, splits, orders and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuskit.config import SEED
from corpuskit.functions import text as T


def numbered(df: DataFrame, *order: Column | str, by: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """df with its rows' numbers from 1, in order, within each group of `by`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _prefixes(df: DataFrame, column: str, buckets: int) -> Column:
    """A prefix of the column's strings that puts them in buckets in their order: three characters more than all have in common, and of frequent ones more, twice as many each time."""
    low, high, total = df.agg(F.min(column), F.max(column), F.count("*")).first()
    text = F.coalesce(F.col(column), F.lit(""))
    common = next((i for i, (a, b) in enumerate(zip(low or "", high or "", strict=False)) if a != b), min(len(low or ""), len(high or "")))
    size, place = common + 3, F.substring(text, 1, common + 3)
    for level in range(8):
        counts = df.select(place.alias("p")).groupBy("p").agg(F.count("*").alias("n")).where((F.col("n") > max(total // buckets * 8, 10_000)) & (F.length("p") >= size))
        hot = [r["p"] for r in counts.collect()]  # at most buckets / 8
        if not hot:
            break
        size += 3 << level
        place = F.when(place.isin(hot), F.substring(text, 1, size)).otherwise(place)
    return place


def ranked(df: DataFrame, order: str | Sequence[str], name: str = "n", by: Sequence[str] = (), buckets: int = 256, weight: str | None = None) -> DataFrame:
    """df with numbers from 0 in order, over all rows or in each group of `by`, without a task that sorts all of them; or with the sum of the column `weight` over all rows before.

    Rows are put in buckets that follow the first column of the order, by prefix if it is a string and by approximate
    quantiles otherwise; a row's number is that in its bucket on top of the rows of all buckets before. Any buckets give the same numbers.
    Rows that are equal in the first column share a bucket.
    """
    order = [order] if isinstance(order, str) else list(order)
    if isinstance(df.schema[order[0]].dataType, StringType):
        place = _prefixes(df, order[0], buckets)
    else:
        cuts = df.agg(F.percentile_approx(order[0], [i / buckets for i in range(1, buckets)])).first()[0] or []
        bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
        place = F.size(F.filter(bounds, lambda c: c <= F.col(order[0])))
    spot = df.withColumn("__part", place)
    counts = spot.groupBy(*by, "__part").agg((F.sum(weight) if weight else F.count("*")).alias("__rows"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    joined = spot.join(before, [*by, "__part"])
    own = Window.partitionBy(*by, "__part").orderBy(*order)
    within = F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(own) - 1
    return joined.withColumn(name, F.col("__before") + within).drop("__part", "__before")


def with_total(df: DataFrame, name: str = "__total") -> DataFrame:
    """df with the number of its rows, joined as one row, so that the rows stay where they are."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in order. Where the order is one column, the n-th key is found first, and no row behind it is sent on to where they are sorted."""
    if len(order) == 1 and isinstance(order[0], str):
        keys = df.select(order[0]).orderBy(order[0]).limit(n)
        found, last, nulls = keys.agg(F.count("*"), F.max(order[0]), F.count_if(F.col(order[0]).isNull())).first()
        if found == n and last is not None and not nulls:
            df = df.where(F.col(order[0]) <= F.lit(last))
    return df.orderBy(*order).limit(n)


def first_rows_of_each(df: DataFrame, n: int, by: Sequence[str], *order: Column | str) -> DataFrame:
    return numbered(df, *order, by=by, name="__rn").where(F.col("__rn") <= n).drop("__rn")


def targets(weights: DataFrame, total: int) -> DataFrame:
    """(source, weight) with target: whole numbers in proportion to the weights that add up to total, by largest remainder."""
    everything = Window.partitionBy()
    share = F.col("weight") / F.sum("weight").over(everything) * total
    down = weights.withColumn("__share", share).withColumn("target", F.floor("__share").cast("bigint"))
    left = F.lit(total) - F.sum("target").over(everything)
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__share") - F.col("target"), 9)), "source"))
    return down.withColumn("__left", left).withColumn("__rn", order).withColumn("target", F.col("target") + (F.col("__rn") <= F.col("__left")).cast("bigint")).drop("__share", "__left", "__rn")


def interleave(docs: DataFrame, weights: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """`total` rows of docs (source, ord, ...), sources in proportion to their weights; those that are too small are gone through again, each time as another epoch. n is the place in the mix."""
    counted = docs.groupBy("source").agg(F.count("*").alias("size"))
    wanted = targets(weights.join(counted, "source").select("source", "weight"), total).join(counted, "source")
    rows = ranked(docs, "ord", "rn", by=["source"]).withColumn("rn", F.col("rn") + 1).join(wanted.select("source", "target", "size"), "source")
    copies = F.explode(F.sequence(F.lit(0), F.floor((F.col("target") - 1) / F.col("size")).cast("int")))
    out = rows.where("target > 0").select("*", copies.alias("epoch")).where("epoch * size + rn <= target")
    key = F.concat_ws("/", F.col("source"), F.col("epoch").cast("string"), F.col("rn").cast("string"))
    out = out.withColumn("__key", T.shuffle_key(key, seed)).drop("target", "size", "rn")
    return ranked(out, "__key").drop("__key")


def strided_split(df: DataFrame, total: int, share: float = 0.05, order: str = "n") -> DataFrame:
    """df with split: every stride-th row of those below total is for validation, up to total x share of them."""
    stride, most = max(1, round(1 / share)), int(total * share)
    n = F.col(order)
    return df.where(n < total).withColumn("split", F.when((n % stride == stride - 1) & (F.floor(n / stride) < most), "validation").otherwise("train"))


def shuffled(df: DataFrame, key: str = "ord", seed: int = SEED) -> DataFrame:
    return df.orderBy(T.shuffle_key(F.col(key), seed), key)


def positional_split(df: DataFrame, tasks: int = 3_000, validation: int = 2_000, least: int = 1_000, order: str = "n") -> DataFrame:
    """The first rows become tasks, the next ones validation, the rest train; too few rows are an error."""
    if (rows := df.count()) < tasks + validation + least:
        raise ValueError(f"{rows} rows are too few for {tasks} tasks and {validation} of validation")
    n = F.col(order)
    return df.withColumn("split", F.when(n < tasks, "tasks").when(n < tasks + validation, "validation").otherwise("train"))


def head_split(df: DataFrame, order: str = "n", part: int = 20) -> DataFrame:
    """The first max(1, rows div part) rows are for validation."""
    first = F.greatest(F.lit(1), F.floor(F.col("__total") / part))
    return with_total(df).withColumn("split", F.when(F.col(order) < first, "validation").otherwise("train")).drop("__total")


def samples_of(tasks: DataFrame, n: int) -> DataFrame:
    """Each task with sample 0 to n - 1."""
    return tasks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))


def chunked(df: DataFrame, size: int, *order: str) -> DataFrame:
    return ranked(df, order, "__n").withColumn("batch_id", F.floor(F.col("__n") / size)).drop("__n")


def epoch_batches(df: DataFrame, batch: int, epoch: int = 0, key: str = "ord", seed: int = SEED) -> DataFrame:
    """df in the epoch's own random order, in batches of `batch` rows; a short last batch is dropped."""
    out = ranked(df.withColumn("__key", F.concat(T.shuffle_key(F.col(key), seed + epoch), F.col(key).cast("string"))), "__key", "__n").drop("__key")
    out = with_total(out).where(F.col("__n") < F.floor(F.col("__total") / batch) * batch).drop("__total")
    return out.withColumn("batch_id", F.floor(F.col("__n") / batch)).withColumn("place", (F.col("__n") % batch).cast("int")).drop("__n")


def token_shares(sources: DataFrame) -> DataFrame:
    """(source, weight, mean_tokens) with token_share, the part of all tokens that the weight of documents gives."""
    product = F.col("weight") * F.col("mean_tokens")
    return sources.withColumn("token_share", product / F.sum(product).over(Window.partitionBy()))


def weights_for(sources: DataFrame) -> DataFrame:
    """(source, token_share, mean_tokens) with the weight of documents that gives these shares."""
    ratio = F.col("token_share") / F.col("mean_tokens")
    return sources.withColumn("weight", ratio / F.sum(ratio).over(Window.partitionBy()))


def code_share(shares: DataFrame) -> DataFrame:
    return shares.groupBy("is_code").agg(F.sum("token_share").alias("token_share"))


def survival(df: DataFrame, keep: Column, tokens: Column) -> DataFrame:
    """By source: rows seen, kept, the share kept, and the mean tokens of those kept."""
    kept = F.count_if(keep)
    return df.groupBy("source").agg(F.count("*").alias("seen"), kept.alias("kept"), (kept / F.count("*")).alias("survival"), (F.coalesce(F.sum(F.when(keep, tokens)), F.lit(0)) / F.greatest(kept, F.lit(1))).alias("mean_tokens"))
