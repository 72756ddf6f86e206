from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpuskit.config import BY_NAME
from corpuskit.operators.tokenizer import Vocabulary
from corpuskit.sources import readers, sinks
from corpuskit.streaming import resume


def record(task, sample, outcome="PASS"):
    return json.dumps({"task_id": task, "sample": sample, "outcome": outcome, "detail": "", "parses": True, "code": "x"})


def test_resume_skips_torn_and_keyless_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([record("a", 0), record("a", 0), json.dumps({"sample": 1}), record("b", 2), record("c", 3)[:25]]))
    path = str(tmp_path / "r.jsonl")
    assert sorted(map(tuple, readers.done_keys(spark, path).collect())) == [("a", 0), ("b", 2)]
    assert readers.malformed(spark, path) == 1
    with pytest.raises(Exception):
        readers.records(spark, path, strict=True).collect()


def test_append_summary_and_splits(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "validation"), ("c", 3, "train")], "text string, ord int, split string")
    assert sorted(map(tuple, sinks.save_splits(df, f"{tmp_path}/d", dry_run=True).collect())) == [("train", 2), ("validation", 1)]
    assert not readers.exists(spark, f"{tmp_path}/d")
    sinks.save_splits(df, f"{tmp_path}/d")
    texts = readers.split_texts(spark, f"{tmp_path}/d", "train")
    assert sorted(r.text for r in texts.collect()) == ["a", "c"]
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<text:string>" in plan
    for _ in range(2):
        sinks.append_records(df, f"{tmp_path}/j")
    assert readers.read(spark, f"{tmp_path}/j", "json", df.schema).count() == 6
    sinks.save_summary(df.groupBy().count(), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first()[0] == 3


def test_cache_by_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, text string")
    v = Vocabulary.new()
    key = sinks.corpus_key(df, v, 0.15, 0.5)
    assert key == sinks.corpus_key(df.repartition(3), v, 0.15, 0.5)
    assert key != sinks.corpus_key(df.withColumn("text", F.lit("c")), v, 0.15, 0.5) and key != sinks.corpus_key(df, v, 0.2, 0.5)
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path), key, make).count() == 2
    assert made == [1]


def test_sources_drop_nulls_and_apply_their_caps(spark):
    rows = [(1, "x" * 19_999), (2, "x" * 20_000), (3, None), (4, ""), (5, "  ")]
    df = spark.createDataFrame(rows, "ord int, content string")
    assert [r.ord for r in readers.documents_of(df, "codeparrot").collect()] == [1]
    rows = [(1, "q", "a", "Python"), (2, "q", "a", None), (3, "q", None, "python"), (4, " ", "a", "python"), (5, "q", "a", "python3"), (6, "q", "a" * 3000, "python")]
    df = spark.createDataFrame(rows, "ord int, problem string, solution string, lang string")
    assert [r.ord for r in readers.documents_of(df, BY_NAME["magicoder_oss"]).collect()] == [1]
    assert sorted(r.ord for r in readers.instruct_rows(df, "magicoder_oss").collect()) == [1, 4, 5, 6]
    assert [r.ord for r in readers.instruct_rows(df, "magicoder_oss", limit=2).collect()] == [1, 4]


def test_pushdown_and_pruning(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000 and lang = 'en'").select("source", "n_chars")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(n_chars,3000)" in plan and "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_stream_appends_each_record_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(record("a", 0) + "\n" + record("a", 0) + "\n" + record("b", 1)[:20])
    args = (f"{tmp_path}/out", f"{tmp_path}/check")
    resume.append_new(resume.record_stream(spark, str(folder)), *args).awaitTermination()
    (folder / "2.json").write_text(record("a", 0) + "\n" + record("b", 1) + "\n")
    resume.append_new(resume.record_stream(spark, str(folder)), *args).awaitTermination()
    rows = spark.read.schema(readers.RECORD).parquet(f"{tmp_path}/out/batch=*").select("task_id", "sample").collect()
    assert sorted(map(tuple, rows)) == [("a", 0), ("b", 1)]


def test_many_batches_read_nothing_again(spark, tmp_path):
    """A batch a file: each key once, and no batch reads the table, so the last takes no longer than the first."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(25):
        (folder / f"{i:03d}.json").write_text("\n".join(record(f"t{j}", i // 5) for j in range(i, i + 4)))
    q = resume.append_new(resume.record_stream(spark, str(folder), files_per_trigger=1), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("task_id", "sample").collect()]
    assert len(rows) == len(set(rows)) == len({(f"t{j}", i // 5) for i in range(25) for j in range(i, i + 4)})
    took = [p["batchDuration"] for p in q.recentProgress if p["numInputRows"]]
    assert len(took) == 25 and sum(took[-5:]) < 3 * sum(took[2:7]) + 2000
