"""The two builds from raw rows to saved splits: instruction pairs, and the corpus of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import MAX_DOCS, SEED, VALIDATION_SHARE, Gates
from corpuskit.functions import text as T
from corpuskit.functions.python import shape
from corpuskit.operators import dedup, filters, mix

#: Rows of a source that pass the gates of the text and go to parser and problems at first, at least.
LOOKED_AT = 256

#: All that can end a pair's way, in the order in which it is asked.
REASONS = ("source_cap", "empty", "prompt_length", "not_a_code_request", "no_fenced_block", "multi_block", "not_python", "code_length", "pair_too_long", "unparseable", "near_duplicate", "benchmark_leak")


def filtered_pairs(rows: DataFrame, sources: Sequence[str], index: DataFrame | None = None, gates: Gates = Gates()) -> DataFrame:
    """rows (source, ord, prompt, response), as of readers.instruct_rows(), with task, code and drop_reason, null for what is kept.

    Sources are gone through in the order given and rows by ord. The gates of the text come first; the parser sees only what passes
    them; of one syntax tree the first pair is kept, and none that restates a problem of the index (entry_point, bench_words);
    what comes behind a source's last pair under its cap isn't looked at: parser and problems get each source's first rows alone, four times
    as many as long as its cap isn't met by them, and all if it never is. The rows are the same for any number to begin with.
    """
    cap, known = gates.per_source, F.coalesce(F.col("source").isin(list(sources)), F.lit(False))
    gated = dedup.checkpointed(filters.with_gate(rows, gates))
    passed = gated.where(known & F.col("drop_reason").isNull()).select("source", "ord")
    ends: dict[str, object] = {}
    most = max(LOOKED_AT, 4 * cap) if cap else 0
    while True:
        if cap:
            # Of sources that haven't met their cap, as many rows as may hold it; of all others what was enough.
            first = mix.first_rows_of_each(passed.where(~F.col("source").isin(list(ends))), most, ["source"], "ord")
            grown = {r["source"]: r["end"] for r in first.groupBy("source").agg(F.max("ord").alias("end"), F.count("*").alias("n")).where(F.col("n") == most).collect()}  # a row a source
        else:
            grown = {}
        beyond = F.lit(False)
        for source, end in (ends | grown).items():
            beyond = beyond | ((F.col("source") == source) & (F.col("ord") > F.lit(end)))
        beyond = F.coalesce(beyond, F.lit(False))
        out = _looked_at(gated.where(known & ~beyond), sources, index, gates)
        kept = {r["source"]: r["n"] for r in out.where("drop_reason is null").groupBy("source").agg(F.count("*").alias("n")).collect()} if grown else {}
        short = [s for s in grown if kept.get(s, 0) < cap]
        if not short:
            break
        # Only sources before the first one that is short have kept what they will keep.
        before = set(sources[: min(map(list(sources).index, short))])
        ends |= {s: end for s, end in grown.items() if s in before}
        most *= 4
    rest = gated.where(~known | beyond).withColumn("drop_reason", F.when(known, "source_cap").otherwise("unknown_source"))
    return out.unionByName(rest.select(*out.columns))


def _looked_at(gated: DataFrame, sources: Sequence[str], index: DataFrame | None, gates: Gates) -> DataFrame:
    """filtered_pairs() of rows that have their gate already."""
    # Where a gate has spoken the parser gets null, which costs it nothing.
    gated = gated.withColumn("shape", F.sha2(shape(F.when(F.col("drop_reason").isNull(), F.col("code"))), 256))
    gated = dedup.checkpointed(gated.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & F.col("shape").isNull(), "unparseable").otherwise(F.col("drop_reason"))))
    leak = F.lit(False)
    if index is not None:
        passed = gated.where("shape is not null").withColumn("__key", F.struct("source", "ord"))
        found = dedup.leaks(passed, index, "__key", prompt="task", threshold=gates.leak).select("__key.source", "__key.ord", F.lit(True).alias("leak"))
        gated, leak = gated.join(found, ["source", "ord"], "left"), F.coalesce("leak", F.lit(False))
    gated = gated.withColumn("leak", leak).withColumnRenamed("drop_reason", "__gate")
    out = dedup.capped_first_wins(gated, gates.per_source, list(sources))
    first = F.col("drop_reason").isin("source_cap", "unknown_source")
    reason = F.when(first, F.col("drop_reason")).otherwise(F.coalesce("__gate", "drop_reason"))
    return out.withColumn("drop_reason", reason).select("source", "ord", "prompt", "response", "task", "code", "drop_reason")


def pair_splits(filtered: DataFrame, tasks: int = 3_000, validation: int = 2_000, least: int = 1_000, seed: int = SEED) -> DataFrame:
    """(source, ord, prompt, completion, split) of the kept pairs, in a random order cut in three: the first ones are tasks, never trained on."""
    kept = filtered.where("drop_reason is null")
    kept = kept.select("source", "ord", T.framed_prompt(F.col("task")).alias("prompt"), T.fenced_python(F.col("code")).alias("completion"))
    key = T.shuffle_key(F.concat_ws("/", "source", F.col("ord").cast("string")), seed)
    return mix.positional_split(mix.ranked(kept.withColumn("__key", key), "__key"), tasks, validation, least).drop("__key")


def corpus_splits(docs: DataFrame, weights: DataFrame, total: int = MAX_DOCS, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """(n, source, ord, epoch, text, split) of documents (source, ord, text), as of readers.documents_of() for each source: mixed by weight up to the cap, every so-many-th for validation."""
    mixed = mix.interleave(docs.select("source", "ord"), weights, total, seed)
    return mix.strided_split(mixed, total, share).join(docs, ["source", "ord"]).select("n", "source", "ord", "epoch", "text", "split")
