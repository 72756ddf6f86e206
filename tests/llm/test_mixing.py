from __future__ import annotations

import itertools

import numpy as np
import pytest

from corpuskit.llm import mixing


def test_probabilities_share_the_budget_and_pass_on_what_is_over(spark):
    def of(rows, budget):
        return {r.s: r.pi for r in mixing.probabilities(spark.createDataFrame(rows, "s string, tokens bigint, weight double"), budget, 0.5).collect()}

    assert of([("a", 100, 1.0), ("b", 1000, 1.0), ("c", 0, 1.0), ("d", 50, 0.0)], 600) == {"a": 1.0, "b": 0.5, "c": 0.5, "d": 0.0}
    assert of([("a", 10, 1.0)], 99) == {"a": 1.0} and of([("a", 10, 1.0)], 0) == {"a": 0.0}
    r = np.random.default_rng(1)
    rows = [(f"s{i}", int(t), float(w)) for i, (t, w) in enumerate(zip(r.integers(1, 1000, 40), r.random(40), strict=True))]
    got, low, high = of(rows, 8000), 0.0, 1e9
    for _ in range(200):  # by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(t, w * mid) for _, t, w in rows) < 8000 else (low, mid)
    assert all(abs(got[s] - min(1.0, w * low / t)) < 1e-6 for s, t, w in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 400])
def test_flight_keeps_both_totals_and_leaves_at_most_two(n):
    r = np.random.default_rng(n)
    pi, tokens = r.random(n), r.integers(0, 50, n).astype(float)
    out = mixing.flight(pi, tokens, 7)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out - pi) @ tokens) < 1e-5


def test_flight_and_landing_are_true_to_each_probability():
    pi, tokens = np.array([0.2, 0.5, 0.8, 0.35, 0.65, 0.1]), np.array([3, 3, 9, 1, 0, 7.0])
    runs = np.mean([mixing.land(mixing.flight(pi, tokens, s), tokens, s + 10**6) for s in range(6000)], axis=0)
    assert np.abs(runs - pi).max() < 0.03


def docs(spark, n=3000):
    r = np.random.default_rng(2)
    rows = [(i, f"s{i % 3}" if i % 10 else "big", "w " * int(r.integers(0, 90))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_sample_meets_totals_of_all_and_each_source(spark):
    df = docs(spark)
    rows = mixing.sample(df, units=200).collect()
    assert len(rows) == 3000
    assert abs(sum(r.pi * r.tokens for r in rows) - 0.7 * sum(r.tokens for r in rows)) < 1e-6
    for s in {r.source for r in rows} | {None}:
        own = [r for r in rows if s in (None, r.source)]
        assert abs(sum(r.selected for r in own) - sum(r.pi for r in own)) <= 3
        assert abs(sum(r.selected * r.tokens for r in own) - sum(r.pi * r.tokens for r in own)) <= 3 * 90


def test_sample_does_not_depend_on_partitions(spark):
    df = docs(spark, 500)
    a, b = ({r.doc_id for r in mixing.sample(x, units=64).where("selected").collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_weights_set_the_shares(spark):
    rows = mixing.sample(docs(spark), weights={"s0": 3, "s1": 1}, fraction=0.2).collect()
    by = {s: sum(r.tokens for r in rows if r.selected and r.source == s) for s in ("s0", "s1", "s2", "big")}
    assert by["s2"] == by["big"] == 0 and abs(by["s0"] / by["s1"] - 3) < 0.15


def test_nulls_repeats_clashes_and_empty(spark):
    schema = "doc_id bigint, source string, text string, s string, tokens int, p int, chosen_id int"
    rows = [(1, "a", "x y", "", 1, 1, 1)] * 2 + [(None, None, None, "", 1, 1, 1), (2, None, "", "", 1, 1, 1), (3, "a", "z " * 500, "", 1, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.source, r.tokens) for r in mixing.sample(df).collect()}
    assert got == {1: ("a", 4), None: (None, 0), 2: (None, 0), 3: ("a", 500)}
    out = mixing.mix(df, fraction=1.0)
    assert out.columns == df.columns and out.count() == 5
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_no_selection_that_keeps_the_probabilities_is_much_nearer(seed):
    """On few documents, the imbalance against that of every possible selection."""
    r = np.random.default_rng(seed)
    n = 10
    pi, tokens = r.random(n), r.integers(1, 20, n).astype(float)
    every = np.array(list(itertools.product((0, 1), repeat=n)))
    count, size = np.abs(every.sum(axis=1) - pi.sum()), np.abs(every @ tokens - pi @ tokens)
    best = (count + size / tokens.mean()).min()
    got = [mixing.land(mixing.flight(pi, tokens, s), tokens, s + 999) for s in range(50)]
    assert all(set(g) <= {0.0, 1.0} for g in got)
    cost = np.array([abs(g.sum() - pi.sum()) + abs((g - pi) @ tokens) / tokens.mean() for g in got])
    independent = np.array([abs(g.sum() - pi.sum()) + abs((g - pi) @ tokens) / tokens.mean() for g in (r.random((50, n)) < pi).astype(float)])
    assert cost.min() >= best - 1e-9 and cost.max() <= 2 + 2 * tokens.max() / tokens.mean() and cost.mean() < independent.mean()


def test_many_sources_and_odd_names(spark):
    """As many sources as hosts of a crawl: no row a source on the driver, and what they leave is landed in buckets."""
    rows = [(i, "\0null" if i % 50 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else f"host{i // 3}", "w " * (i % 17)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.sample(df, units=100).collect()
    assert {r.doc_id: r.source for r in got} == {i: s for i, s, _ in rows}
    assert abs(sum(r.selected * r.tokens for r in got) - sum(r.pi * r.tokens for r in got)) <= 3 * 17
    assert abs(sum(r.selected for r in got) - sum(r.pi for r in got)) <= 3
