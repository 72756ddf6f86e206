"""Writers. Spark's commit protocol makes each of them appear whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.numeric import fingerprint
from corpuskit.sources.readers import exists


def save_splits(df: DataFrame, path: str, dry_run: bool = False, mode: str = "errorifexists") -> DataFrame:
    """df, by split, as Parquet; returns the rows of each split. A dry run writes nothing."""
    if not dry_run:
        df.write.mode(mode).partitionBy("split").parquet(path)
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def json_line(*columns: str) -> Column:
    """The columns as one JSON line, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_summary(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def corpus_key(docs: DataFrame, vocabulary, *parameters: object, key: str = "ord", text: str = "text") -> str:
    """What a compiled corpus depends on, in 16 digits: texts and their order keys, ids, merges and parameters."""
    content = docs.select(F.count("*").alias("n"), F.sum(F.xxhash64(key, text).cast("decimal(38,0)")).alias("h"))
    ids = F.lit(repr(sorted(vocabulary.ids.items())))
    merges = F.lit(repr(sorted(vocabulary.ranks.items(), key=lambda x: x[1])))
    return content.select(fingerprint(F.col("n"), F.col("h"), ids, merges, F.lit(repr(parameters))).alias("k")).first()["k"]


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that key, made and written only if it isn't there."""
    path = f"{folder}/corpus-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
