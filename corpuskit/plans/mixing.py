"""Queries over mixes, splits, orders and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.config import SOURCES
from corpuskit.functions import text as T
from corpuskit.operators import builds, dedup, mix
from corpuskit.plans.registry import query, table
from corpuskit.sources import readers

WEIGHTS = [("src0", 0.5), ("src1", 0.25), ("src2", 0.15), ("src3", 0.1)]
_VALUES = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS)
#: As many documents are mixed as there are.
_TOTAL = "(SELECT count(*) FROM documents)"


def total(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), "n_chars")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "source string, weight double")


_MIXED = f"""
docs AS (SELECT source, doc_id AS ord, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS size FROM documents),
w(source, weight) AS (VALUES {_VALUES}),
shares AS (SELECT source, weight / sum(weight) OVER () * {_TOTAL} AS share FROM w WHERE source IN (SELECT source FROM docs)),
floors AS (SELECT *, floor(share)::BIGINT AS low, {_TOTAL} - sum(floor(share)::BIGINT) OVER () AS rest, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) AS r FROM shares),
goals AS (SELECT source, low + CASE WHEN r <= rest THEN 1 ELSE 0 END AS target FROM floors),
copies AS (SELECT source, ord, rn, size, target, unnest(range(0, (target - 1) // size + 1)) AS epoch FROM docs JOIN goals USING (source)),
mixed AS (SELECT source, ord, epoch::INTEGER AS epoch, row_number() OVER (ORDER BY md5(source || '/' || epoch || '/' || rn || '|1738')) - 1 AS n FROM copies WHERE epoch * size + rn <= target)
"""


@query(f"WITH {_MIXED} SELECT source, ord, epoch, n FROM mixed")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; small ones are gone through again."""
    return mix.interleave(documents(spark, sf_dir), weights(spark), total(spark, sf_dir)).select("source", "ord", "epoch", "n")


@query(f"WITH {_MIXED} SELECT source, count(*) AS docs, max(epoch) + 1 AS epochs FROM mixed GROUP BY source")
def epochs_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix.interleave(documents(spark, sf_dir), weights(spark), total(spark, sf_dir))
    return m.groupBy("source").agg(F.count("*").alias("docs"), (F.max("epoch") + 1).alias("epochs"))


@query(f"WITH {_MIXED} SELECT n, source, ord, CASE WHEN n % 20 = 19 AND n // 20 < floor({_TOTAL} * 3 // 4 * 0.05) THEN 'validation' ELSE 'train' END AS split FROM mixed WHERE n < {_TOTAL} * 3 // 4")
def strided_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global cap, and every 20th document for validation."""
    m = mix.interleave(documents(spark, sf_dir), weights(spark), total(spark, sf_dir))
    return mix.strided_split(m, total(spark, sf_dir) * 3 // 4, 0.05).select("n", "source", "ord", "split")


@query("SELECT doc_id AS ord, row_number() OVER (ORDER BY md5(doc_id || '|1738'), doc_id)::INTEGER AS place FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("ord").withColumn("key", T.shuffle_key(F.col("ord")))
    return mix.ranked(d, ["key", "ord"]).select("ord", (F.col("n") + 1).cast("int").alias("place"))


@query("""SELECT doc_id AS ord, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '|1738')) - 1 < 60 THEN 'tasks' WHEN row_number() OVER (ORDER BY md5(doc_id || '|1738')) - 1 < 100 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix.ranked(documents(spark, sf_dir).select("ord").withColumn("key", T.shuffle_key(F.col("ord"))), "key")
    return mix.positional_split(d, 60, 40, 50).select("ord", "split")


@query("""WITH s AS (SELECT doc_id, CASE WHEN row_number() OVER w <= 60 THEN 'tasks' WHEN row_number() OVER w <= 100 THEN 'validation' ELSE 'train' END AS split FROM documents WINDOW w AS (ORDER BY md5(doc_id || '|1738')))
SELECT split, count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) > 1)) AS elsewhere FROM s GROUP BY split""")
def splits_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three splits, how many rows and ids each has, and how many ids another has too: none."""
    d = mix.ranked(documents(spark, sf_dir).select("ord").withColumn("key", T.shuffle_key(F.col("ord"))), "key")
    held = mix.positional_split(d, 60, 40, 50).groupBy("ord").agg(F.collect_set("split").alias("splits"), F.count("*").alias("n"))
    each = held.select("ord", "n", F.explode("splits").alias("split"), (F.size("splits") > 1).alias("elsewhere"))
    return each.groupBy("split").agg(F.sum("n").alias("rows"), F.count_distinct("ord").alias("ids"), F.count_if("elsewhere").alias("elsewhere"))


_SEVEN = ", ".join(f"'{s.name}'" for s in SOURCES)


@query(f"""
WITH raw AS (SELECT doc_id AS ord, text, [{_SEVEN}][doc_id % 7 + 1] AS source FROM documents),
made AS (SELECT source, ord, CASE source WHEN 'codeparrot' THEN '```python\n' || trim(text) || '\n```' WHEN 'cosmo' THEN trim(text) ELSE '## Task\nwrite python ' || ord || '\n\n## Solution\n' || trim(text) END AS text
  FROM raw WHERE length(text) < CASE source WHEN 'codeparrot' THEN 20000 WHEN 'cosmo' THEN 8000 ELSE 3000 END AND trim(text) <> ''
    AND (source IN ('codeparrot', 'cosmo', 'magicoder_evol', 'glaive') OR ord % 5 <> 0) AND (source <> 'cosmo' OR ord % 3 <> 0)),
w(source, weight) AS (VALUES {", ".join(f"('{s.name}', {s.weight}::DOUBLE)" for s in SOURCES)}),
docs AS (SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn, count(*) OVER (PARTITION BY source) AS size FROM made),
shares AS (SELECT source, weight / sum(weight) OVER () * {_TOTAL} AS share FROM w WHERE source IN (SELECT source FROM docs)),
floors AS (SELECT *, floor(share)::BIGINT AS low, {_TOTAL} - sum(floor(share)::BIGINT) OVER () AS rest, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) AS r FROM shares),
goals AS (SELECT source, low + CASE WHEN r <= rest THEN 1 ELSE 0 END AS target FROM floors),
copies AS (SELECT source, ord, rn, size, target, unnest(range(0, (target - 1) // size + 1)) AS epoch FROM docs JOIN goals USING (source)),
mixed AS (SELECT source, ord, epoch::INTEGER AS epoch, row_number() OVER (ORDER BY md5(source || '/' || epoch || '/' || rn || '|1738')) - 1 AS n FROM copies WHERE epoch * size + rn <= target)
SELECT n, source, ord, epoch, text, CASE WHEN n % 20 = 19 AND n // 20 < floor({_TOTAL} * 0.05) THEN 'validation' ELSE 'train' END AS split FROM mixed JOIN made USING (source, ord)""")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven sources, each with its filters and template, mixed by their weights and split. A document's source follows from its id."""
    raw = readers.ordered(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    k = F.col("ord")
    parts = []
    for i, s in enumerate(SOURCES):
        own = raw.where(k % 7 == i).withColumnRenamed("text", s.response)
        if s.kind == "prose":
            own = own.withColumn("audience", F.lit("General")).withColumn("format", F.when(k % 3 == 0, "blogpost").otherwise("WikiHow"))
        if s.prompt:
            own = own.withColumn(s.prompt, F.concat(F.lit(" write python "), k.cast("string"), F.lit("\n")))
        if s.language:
            own = own.withColumn(s.language, F.when(k % 5 == 0, "rust").otherwise("Python"))
        parts.append(readers.documents_of(own, s))
    docs = dedup.checkpointed(reduce(DataFrame.unionByName, parts))
    shares = spark.createDataFrame([(s.name, s.weight) for s in SOURCES], "source string, weight double")
    return builds.corpus_splits(docs, shares, total(spark, sf_dir))


@query("""SELECT doc_id AS ord, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < greatest(1, count(*) OVER () // 20) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.head_split(mix.ranked(documents(spark, sf_dir).select("ord"), "ord")).select("ord", "split")


@query("SELECT doc_id AS ord, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def first_fifty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.first_rows(documents(spark, sf_dir).select("ord", "n_chars"), 50, "ord")


@query("""SELECT doc_id AS ord, (row_number() OVER (ORDER BY length(text), doc_id) - 1) // 16 AS batch_id FROM documents""")
def batches_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work in order of length, in batches of 16."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.length("text").alias("len"))
    d = dedup.checkpointed(d)  # else each bucket's bound would measure the text again
    return mix.chunked(d, 16, "len", "ord").select("ord", "batch_id")


@query("SELECT item_id AS task_id, unnest(range(0, 5))::INTEGER AS sample FROM benchmark")
def task_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.samples_of(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id")), 5)


@query("""WITH k AS (SELECT doc_id AS ord, row_number() OVER (ORDER BY md5(doc_id || '|1741'), doc_id::VARCHAR) - 1 AS n, count(*) OVER () AS total FROM documents)
SELECT ord, n // 32 AS batch_id, (n % 32)::INTEGER AS place FROM k WHERE n < total // 32 * 32""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth epoch's batches of 32; the short one is dropped."""
    return mix.epoch_batches(documents(spark, sf_dir).select("ord"), 32, epoch=3)


_MEANS = dict(zip("codefeedback codeparrot cosmo glaive magicoder_evol magicoder_oss tinycodes".split(), (230, 1100, 900, 210, 240, 260, 170), strict=True))
_SOURCES = ", ".join(f"('{s.name}', {s.weight}::DOUBLE, {_MEANS[s.name]}::DOUBLE, {str(s.is_code).lower()})" for s in SOURCES)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.weight, float(_MEANS[s.name]), s.is_code) for s in SOURCES], "source string, weight double, mean_tokens double, is_code boolean")


@query(f"WITH s(source, weight, mean_tokens, is_code) AS (VALUES {_SOURCES}) SELECT source, round(weight * mean_tokens / sum(weight * mean_tokens) OVER (), 9) AS token_share FROM s")
def token_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.token_shares(sources(spark)).select("source", F.round("token_share", 9).alias("token_share"))


@query(f"""WITH s(source, weight, mean_tokens, is_code) AS (VALUES {_SOURCES}), t AS (SELECT *, weight * mean_tokens / sum(weight * mean_tokens) OVER () AS share FROM s)
SELECT source, round(share / mean_tokens / sum(share / mean_tokens) OVER (), 9) AS solved FROM t""")
def weights_from_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights that give the shares of the weights: themselves."""
    return mix.weights_for(mix.token_shares(sources(spark)).drop("weight")).select("source", F.round("weight", 9).alias("solved"))


@query(f"""WITH s(source, weight, mean_tokens, is_code) AS (VALUES {_SOURCES}), t AS (SELECT *, weight * mean_tokens / sum(weight * mean_tokens) OVER () AS share FROM s)
SELECT is_code, round(sum(share), 9) AS token_share FROM t GROUP BY is_code""")
def code_and_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.code_share(mix.token_shares(sources(spark))).select("is_code", F.round("token_share", 9).alias("token_share"))


@query("""SELECT source, count(*) AS seen, count(*) FILTER (WHERE n_chars < 3000) AS kept, round(count(*) FILTER (WHERE n_chars < 3000) / count(*), 9) AS survival,
round(coalesce(sum(n_chars) FILTER (WHERE n_chars < 3000), 0) / greatest(count(*) FILTER (WHERE n_chars < 3000), 1), 9) AS mean_tokens FROM documents GROUP BY source""")
def source_survival_and_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.survival(documents(spark, sf_dir), F.col("n_chars") < 3000, F.col("n_chars"))
    return out.withColumn("survival", F.round("survival", 9)).withColumn("mean_tokens", F.round("mean_tokens", 9))


@query("""SELECT event_id AS task_id, (event_id % 4)::INTEGER AS sample FROM events WHERE event_id % 3 <> 0""")
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work minus what is done."""
    work = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), (F.col("event_id") % 4).cast("int").alias("sample"))
    return dedup.remaining(work, work.where("task_id % 3 = 0"), ["task_id", "sample"])


@query("""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pool_rank, item_id)::INTEGER AS rn FROM (
SELECT item_id, 0 AS pool_rank FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 1 FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT doc_id, 2 FROM documents)) WHERE rn <= 45""")
def task_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools after one another, up to a limit."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    first = mix.first_rows(dedup.pool(b.where("item_id % 2 = 0"), b.where("item_id % 2 = 1"), d), 45, "pool_rank", "item_id")
    return mix.numbered(first, "pool_rank", "item_id")
