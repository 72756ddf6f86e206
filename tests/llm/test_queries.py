from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from corpuskit.llm import near_dedup, packing, pii, sharding, token_blocks, toxicity
from corpuskit.llm._text import word_hashes
from corpuskit.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY
from tests.llm.test_pii import brute, luhn
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) > 0


def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1_meets_its_totals(spark, sf_dir):
    rows = QUERIES["op1_mixing"](spark, sf_dir).collect()
    all_ = docs(spark, sf_dir)
    assert {r.doc_id: (r.source, r.tokens) for r in rows} == {i: (d.source, len(d.text.split())) for i, d in all_.items()}
    longest = max(r.tokens for r in rows)
    for by in (lambda r: 0, lambda r: r.source):
        for key in {by(r) for r in rows}:
            own = [r for r in rows if by(r) == key]
            assert abs(sum(r.selected - r.pi for r in own)) <= 3 and abs(sum((r.selected - r.pi) * r.tokens for r in own)) <= 3 * longest


def test_op2_scores_every_document_as_the_network_does(spark, sf_dir):
    labels, all_ = spark.read.parquet(f"{sf_dir}/labels.parquet"), docs(spark, sf_dir)
    net = toxicity.fit_to_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf_dir).collect()}
    ids = sorted(all_)
    score, n = net.score_texts([all_[i].text for i in ids])
    assert rows.keys() == all_.keys() and np.allclose([rows[i].score for i in ids], score, atol=1e-4) and [rows[i].windows for i in ids] == n.tolist()


def test_op3_has_the_nearest(spark):
    """Recall over the query set of a table of more than one shard, and each query's."""
    sf_dir = "/root/testdata/sf0.1"
    got = defaultdict(set)
    for r in QUERIES["op3_ann"](spark, sf_dir).collect():
        got[r.vec_id].add(r.neighbour)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0)
    each = []
    for i in got:
        d = ((v - v[ids == i]) ** 2).sum(axis=1)
        d[ids == i] = np.inf
        each.append(len(got[i] & set(ids[np.argsort(d, kind="stable")[:10]].tolist())) / 10)
    assert np.mean(each) >= 0.97 and np.min(each) >= 0.5


def test_op4_texts_come_back(spark, sf_dir):
    encoding = token_blocks._encoding(VOCABULARY)
    all_ = docs(spark, sf_dir)
    rows = QUERIES["op4_token_blocks"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(all_)
    for r in rows:
        ids = token_blocks.decode(bytes(r.payload), r.block_starts)
        assert len(ids) == r.n_tokens and encoding.decode(ids.tolist()) == all_[r.doc_id].text


def test_op7_packs_every_token(spark, sf_dir):
    used, tokens = Counter(), Counter()
    for r in QUERIES["op7_packing"](spark, sf_dir).collect():
        used[r.block, r.bin] += r.tokens
        tokens[r.doc_id] += r.tokens
    assert max(used.values()) <= packing.CAPACITY and tokens == Counter({i: len(d.text.split()) for i, d in docs(spark, sf_dir).items()})
    assert len(used) <= 1.02 * sum(used.values()) / packing.CAPACITY + 1


def test_op8_is_brute_force_over_the_whole_table(spark, sf_dir):
    all_ = docs(spark, sf_dir)
    want = brute([d.text for d in all_.values()], pii.WINDOW, pii.ALPHA, pii.GENERALISE)
    pairs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text")
    got = {(r.entity, r.term): r.share for r in pii.disclosures(pairs).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    patterns = {k: regex.compile(p) for k, p in pii.ENTITIES.items()}
    rows = QUERIES["op8_pii"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(all_) and sum(r.terms for r in rows) > 0
    gone = defaultdict(set)
    for e, w in want:
        gone[e].add(w)
    for r in rows:
        found = [m[0] for k, p in patterns.items() for m in p.finditer(all_[r.doc_id].text) if k != "CARD" or luhn(m[0])]
        assert bool(found) == (r.entities > 0) and not any(k != "CARD" or luhn(m[0]) for k, p in patterns.items() for m in p.finditer(r.text))
        if not found:
            assert r.text == all_[r.doc_id].text and r.terms == 0
        left = set(regex.findall(r"[\p{L}\p{N}]+", r.text.lower()))
        assert not left & set().union(*(gone[e.lower()] for e in found))


def test_op9_has_the_groups_of_brute_force(spark, sf_dir):
    words = sorted((len(w := word_hashes([d.text])[0].tolist()), i, w) for i, d in docs(spark, sf_dir).items())
    root = {i: i for _, i, _ in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (short, a, x) in enumerate(words):
        for long, b, y in words[n + 1 :]:
            if short < near_dedup.THRESHOLD * long - 1e-9:
                break
            if near_dedup._similar(x, y, near_dedup.THRESHOLD):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert {r.doc_id: r.group_id for r in QUERIES["op9_near_dedup"](spark, sf_dir).collect()} == {i: find(i) for i in root}


def test_op10_shards_are_sorted_ranges(spark, sf_dir):
    df = QUERIES["op10_sharding"](spark, sf_dir)
    all_ = docs(spark, sf_dir)
    rows = df.collect()
    assert {r.doc_id: r.text for r in rows} == {i: d.text for i, d in all_.items()}
    key = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in all_}
    assert all(r.sort_key == key[r.doc_id] and r.n_bytes == len(r.text.encode()) for r in rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.sort_key))] == sorted(all_, key=key.get)
    assert max(r.shard for r in rows) == sum(r.n_bytes for r in rows) // sharding.SHARD_BYTES
