"""Runs that can be broken off: what is on disk already isn't made again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import dedup, mix, stats
from corpuskit.sources import readers, sinks

#: From (task_id, sample, prompt, ...) to the same rows with a column completion.
Generator = Callable[[DataFrame], DataFrame]
#: From (task_id, sample, code, test_code, setup_code) to records, such as sandbox.run_candidates.
Runner = Callable[[DataFrame], DataFrame]


def evaluate(tasks: DataFrame, generate: Generator, run: Runner, path: str, samples: int = 5, ks: Sequence[int] = (1, 5, 10), bare: bool = False) -> DataFrame:
    """The summary of `samples` completions of each task (task_id, prompt, test_code, setup_code).

    Each task is taken so many times; what the folder of JSON lines has a whole record of is left out; the rest is generated, its code
    run and appended; and all records of the folder are summed up, for each k of at most so many samples. If bare, completions are code without a fence.
    """
    spark = tasks.sparkSession
    work = mix.samples_of(tasks, samples)
    if readers.exists(spark, path):
        work = dedup.remaining(work, dedup.checkpointed(readers.done_keys(spark, path)), ["task_id", "sample"])
    made = generate(work)
    code = F.col("completion") if bare else T.extract_code(F.col("completion"))
    candidates = made.select("task_id", "sample", code.alias("code"), "test_code", "setup_code")
    sinks.append_records(run(candidates).select(*readers.RECORD.fieldNames()), path)
    return stats.summary(readers.records(spark, path), [k for k in ks if k <= samples])


def sample_and_label(tasks: DataFrame, generate: Generator, run: Runner, path: str, samples: int = 8) -> DataFrame:
    """(task_id, prompt, samples: array of (code, outcome)) of all tasks in the folder of JSON lines, to which those that it lacks have been added, always with all their samples."""
    spark = tasks.sparkSession
    if readers.exists(spark, path):
        done = readers.done_keys(spark, path, ("task_id",), readers.SAMPLE_GROUP)
        tasks = dedup.remaining(tasks, dedup.checkpointed(done), ["task_id"])
    made = generate(mix.samples_of(tasks, samples))
    found = run(made.select("task_id", "sample", F.col("completion").alias("code"), "test_code", "setup_code")).select("task_id", "sample", "code", "outcome")
    held = F.transform(F.array_sort(F.collect_list(F.struct("sample", "code", "outcome"))), lambda s: F.struct(s["code"].alias("code"), s["outcome"].alias("outcome")))
    groups = found.groupBy("task_id").agg(held.alias("samples")).join(tasks.select("task_id", "prompt"), "task_id")
    sinks.append_records(groups.select("task_id", "prompt", "samples"), path)
    return readers.records(spark, path, readers.SAMPLE_GROUP)
