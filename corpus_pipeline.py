"""The corpus pipeline: documents go through five stages, each on all that the one before kept.

toxicity    documents that the classifier finds toxic go
near_dedup  of each group of exact and near copies the document of least id stays
pii         entities and the terms that disclose them are generalised or removed from texts
mixing      documents are sampled so that sources have their target shares of tokens
packing     what remains is packed into sequences; the result says which tokens of which document are in which

All stages but the last return the columns of documents, others of any name included. Rows of null text pass all stages and are in no sequence;
rows of null id pass near_dedup ungrouped, and as one unit mixing; repeated rows are one after near_dedup; empty texts and very long ones pass as any
other, whole; of equal texts the least id stays; empty tables give no rows. ORACLE_SQL is None, as neither the network nor the
alignment, the flight phase or the packing can be put in SQL; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import mixing, near_dedup, packing, pii, toxicity
from corpuskit.llm._spark import checkpoint_dir, cut


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_copies),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again as the next one's; nothing of these stays, whether it ends well or not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        _delete(spark, folder)
