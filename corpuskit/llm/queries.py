"""The queries of this package's operators over their whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import ann, fingerprints, mixing, near_dedup, packing, pii, sharding, token_blocks, toxicity, url_lists

#: The file of a public vocabulary; its folder is the environment's to name.
VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.neighbours(rows, rows.where(F.col("vec_id") % ann.EVERY == 0))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encode_texts(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.in_corpus(table(spark, sf_dir, "documents"))
    # The oracle's arrays are compared as text.
    return made.withColumn("sketch", F.array_join("sketch", ",")).withColumn("containment", F.round("containment", 9)).withColumn("shared", F.col("shared").cast("bigint"))


def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.containers(table(spark, sf_dir, "documents"), F.col("id") % fingerprints.EVERY == 0)
    return found.withColumns({c: F.round(c, 9) for c in ("containment", "contained")})


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_lists.evaluate(url_lists.derived_captures(pages), url_lists.derived_entries(pages))
    return found.withColumn("valid_from", F.unix_seconds("valid_from"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.hash_key("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_ann": op3_ann,
    "op4_token_blocks": op4_token_blocks,
    "op5_fingerprints": op5_fingerprints,
    "op5_containment": op5_containment,
    "op6_url_lists": op6_url_lists,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op5_fingerprints": fingerprints.IN_CORPUS_SQL,
    "op5_containment": fingerprints.CONTAINERS_SQL,
    "op6_url_lists": url_lists.EVALUATE_SQL,
}
