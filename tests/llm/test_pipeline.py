from __future__ import annotations

import os
from collections import defaultdict

import corpus_pipeline
from corpuskit.llm import mixing, near_dedup, packing, pii, toxicity
from tests.llm.test_toxicity import labelled


def tables(spark, folder):
    texts, toxic = labelled(500, seed=21)
    clean = [t for t, b in zip(texts, toxic, strict=True) if not b]
    long = max(clean, key=len)
    words = long.split()
    words[3] = "changed"
    more = [long, long.upper(), " ".join(words), f"{clean[1]} write to ann@x.example.com or +1 (456) 555-2186", "", None]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts + more)]
    rows += [rows[1], (None, "null id", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(toxic)], "doc_id bigint, toxic int")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return docs, labels, texts, toxic


def test_each_stage_does_what_brute_force_does_and_run_is_all_of_them(spark, tmp_path):
    docs, labels, texts, toxic = tables(spark, tmp_path)
    sf = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]

    net = toxicity.fit_to_labels(docs, labels)
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    kept = kept.collect()
    score = {t: net.score_texts([t])[0][0] for t in {r.text for r in docs.collect() if r.text is not None}}
    want = [r for r in docs.collect() if r.text is None or score[r.text] < 0.5]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))
    caught = {i for i, b in enumerate(toxic) if b} - {r.doc_id for r in kept}
    assert len(caught) > 0.9 * sum(toxic) and len([r for r in kept if r.doc_id is not None and r.doc_id < 500 and not toxic[r.doc_id]]) > 0.95 * (500 - sum(toxic))

    docs = spark.createDataFrame(kept, docs.schema)
    kept = stages["near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    kept = kept.collect()
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    text = {r.doc_id: r.text for r in docs.collect()}
    gone = set()
    for n, i in enumerate(ids):  # groups here are pairs and stars, so the least id is met first
        for j in ids[:n]:
            if j not in gone and j < i and text[i] is not None and text[j] is not None and (text[i] == text[j] or text[i] and text[j] and near_dedup.similar(text[j], text[i])):
                gone.add(i)
                break
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(ids) - gone) and len(gone) >= 3

    docs = spark.createDataFrame(kept, docs.schema)
    kept = stages["pii"](spark, docs, sf)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == docs.count()
    for r in kept:
        was = text[r.doc_id]
        if was is not None and "@" in was:
            assert "ann@" not in r.text and "<EMAIL>" in r.text and "<PHONE>" in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == was

    docs = spark.createDataFrame(kept, docs.schema)
    kept = stages["mixing"](spark, docs, sf)
    assert kept.columns == docs.columns
    rows = mixing.sample(docs).collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.selected}
    assert abs(sum(r.tokens * r.selected for r in rows) - 0.7 * sum(r.tokens for r in rows)) < 400

    out = stages["packing"](spark, kept, sf).collect()
    used, tokens = defaultdict(int), defaultdict(int)
    for r in out:
        tokens[r.doc_id] += r.tokens
        if r.bin is not None:
            used[r.block, r.bin] += r.tokens
    assert max(used.values()) <= packing.CAPACITY
    assert dict(tokens) == {r.doc_id: len((r.text or "").split()) for r in kept.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted(map(tuple, out), key=repr)


def test_empty_tables(spark, tmp_path):
    docs, labels, *_ = tables(spark, tmp_path / "full")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and pii.ENTITIES


def test_odd_rows_and_columns_pass_every_stage(spark, tmp_path):
    """Very long texts, nulls, ties, repeated rows and columns that have the names of the stages' own."""
    docs, labels, texts, toxic = tables(spark, tmp_path / "plain")
    clean = next(t for t, b in zip(texts, toxic, strict=True) if not b)
    long = " ".join(f"{w}{i % 5000}" for i, w in enumerate((clean.split() * 40_000)[:250_000]))
    rows = [(9000, long, "en", "s0", len(long)), (9001, long + " end", "en", "s0", None), (9002, None, "en", None, None), (9003, "?!", None, None, 2), (9003, "?!", None, None, 2), (None, None, None, None, None), (None, long, "en", "s1", 5)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for c in ("id", "key", "bin", "p", "s", "tokens", "scored", "pii_text", "root", "links", "group_id", "selected", "bucket"):
        docs = docs.withColumn(c, docs["n_chars"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, at, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in at.select("doc_id").collect()]
        assert (9001 in ids) == (name == "toxicity"), name
        if name in ("near_dedup", "pii"):
            assert ids.count(9000) == ids.count(9002) == ids.count(9003) == 1
    out = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    chosen = [r for r in at.collect()]
    assert sum(r.tokens for r in out) == sum(len((r.text or "").split()) for r in chosen)


def test_no_folder_stays(spark, tmp_path):
    tables(spark, tmp_path)
    folder = corpus_pipeline.checkpoint_dir(spark).removeprefix("file:")
    corpus_pipeline.run(spark, str(tmp_path))
    assert not [x for x in os.listdir(folder) if x.startswith("pipeline-")]
