from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuskit.config import SOURCES
from corpuskit.operators import builds
from corpuskit.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_branch_has_rows(spark):
    reasons = {r.drop_reason for r in QUERIES["gate_cascade"](spark, SF).select("drop_reason").distinct().collect()}
    assert reasons == {None, *builds.REASONS[1:9]}
    reasons = {r.drop_reason for r in QUERIES["instruction_build"](spark, SF).select("drop_reason").distinct().collect()}
    assert reasons == {None, *builds.REASONS}
    assert {r.split for r in QUERIES["instruction_splits"](spark, SF).collect()} == {"tasks", "validation", "train"}
    assert QUERIES["filter_report"](spark, SF).where("source = 'TOTAL'").first().leaks > 0
    assert {r.source for r in QUERIES["corpus_build"](spark, SF).select("source").distinct().collect()} == {s.name for s in SOURCES}
    kinds = QUERIES["request_kinds"](spark, SF).groupBy("asks", "conceptual").count().count()
    assert kinds == 4
    assert {r.is_python for r in QUERIES["python_heuristic"](spark, SF).collect()} == {True, False}
    assert {r.drop_reason for r in QUERIES["first_wins"](spark, SF).select("drop_reason").distinct().collect()} == {None, "near_duplicate", "benchmark_leak"}
    assert {r.drop_reason for r in QUERIES["first_wins_under_a_cap"](spark, SF).select("drop_reason").distinct().collect()} == {None, "near_duplicate", "source_cap"}
    epochs = {r.source: r.epochs for r in QUERIES["epochs_of_sources"](spark, SF).collect()}
    assert max(epochs.values()) > min(epochs.values()) >= 1
    t = QUERIES["templates"](spark, SF).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("task_text", "fenced", "prose"))).first()
    assert min(t) > 0
    kinds = {r["first"] for r in QUERIES["filled_in_middle"](spark, SF).collect()}
    assert -2 in kinds and len(kinds) > 2
    s = QUERIES["evaluation_summary"](spark, SF).first()
    assert s.samples == 10_000 and 0 < s.n_incomplete < s.tasks
    assert QUERIES["splits_apart"](spark, SF).agg(F.sum("elsewhere")).first()[0] == 0
    assert QUERIES["learned_vocabulary"](spark, SF).count() > 4000


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_mixes_do_not_depend_on_partitions(spark, partitions):
    from corpuskit.operators import mix
    from corpuskit.plans import mixing

    d = mixing.documents(spark, SF)
    want = sorted(map(tuple, QUERIES["interleaved"](spark, SF).collect()))
    got = mix.interleave(d.repartition(partitions), mixing.weights(spark), mixing.total(spark, SF)).select("source", "ord", "epoch", "n")
    assert sorted(map(tuple, got.collect())) == want


def test_pairs_behind_a_met_cap_are_not_looked_at(spark, monkeypatch):
    from corpuskit.config import Gates
    from corpuskit.operators import dedup
    from corpuskit.plans import texts

    seen, leaks = [], dedup.leaks
    monkeypatch.setattr(dedup, "leaks", lambda rows, *args, **options: seen.append(rows.count()) or leaks(rows, *args, **options))
    fixture, index = texts.instruct_fixture(spark, SF), texts.problem_index(spark, SF)
    found = {}
    for n in (10_000, 1):
        monkeypatch.setattr(builds, "LOOKED_AT", n)
        made = builds.filtered_pairs(fixture, ["s0", "s1", "s2"], index, Gates(per_source=2))
        found[n] = sorted(map(repr, made.select("source", "ord", "drop_reason").collect()))
    assert found[1] == found[10_000]
    assert seen[1] < seen[0]
