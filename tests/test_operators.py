from __future__ import annotations

import json
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from corpuskit.config import SOURCES
from corpuskit.functions import numeric as N
from corpuskit.functions import python as P
from corpuskit.functions import text as T
from corpuskit.operators import builds, dedup, evaluation, filters, mix, preferences, sandbox, stats


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_strip_and_lines_are_pythons(spark):
    texts = ["  a\t", "\x1c b\x85 ", "a\nb\r\nc\x0bd\x0ce\x1cf\x85g\u2028h", "a\n", "\n\n", "", "x\r"]
    for t, (s, ln) in zip(texts, values(spark, texts, T.strip(F.col("t")), T.lines(F.col("t"))), strict=True):
        assert s == t.strip() and ln == t.splitlines()


def test_language_heuristic_probes(spark):
    probes = {"def f(): import os": True, "print in Python": True, "x = [i for i in y]": False, "python and std::vector": False, "```js \nx python": False, "```js\nx python": True, "python System.out.print": True}
    got = [r[0] for r in values(spark, list(probes), T.looks_python(F.col("t")))]
    assert got == list(probes.values())
    assert values(spark, ["python System.out.print"], T.looks_python(F.col("t"), strict=True)) == [(False,)]


def test_def_names_by_python_line_rules(spark):
    assert values(spark, ["def a(): 1\n  def  b(x):\r def c(): 0\u2028def d()", "def\u00a0e()", "xdef f()"], T.def_names(F.col("t"))) == [(["a", "b"],), (["e"],), ([],)]


def test_templates_and_their_inverse(spark):
    got = values(spark, ["## Task\na\nYour code should satisfy: x\nb\n\n## Solution\nz", "plain", "## Task\nq ## Task\nr"], T.bare_task(F.col("t")))
    assert [g[0] for g in got] == ["a\nb", "plain", "q ## Task\nr"]
    got = values(spark, ["a```py\n\nx\n\n```b", "```\ny", " z ", "```py x"], T.extract_code(F.col("t")), T.before_fence(F.col("t")))
    assert got == [("x", "a"), ("y", ""), ("z", " z "), ("```py x", "")]
    assert values(spark, ["```python\nx = 1\npython\n```", "`a`"], T.unwrapped(F.col("t"))) == [("x = 1\npython\n",), ("a",)]


def test_shapes_and_parsing():
    assert P.shape_of("def f(a):\n return a.b + 1") == P.shape_of("def g(x):\n return x.y + 2") != P.shape_of("def g(x):\n return x.y - 2")
    assert P.shape_of("def (") is None and P.shape_of("\0") is None and P.shape_of(None) is None
    assert P.shape_of("async def f(): pass") != P.shape_of("def f(): pass")


def test_syntax_is_checked_only_behind_the_other_gates(spark):
    ok = "x_value = compute(1, 2, 3)\n" * 4
    rows = [("s", 1, "Write a function that adds numbers", f"```python\n{ok}```"), ("s", 2, "Write a function that adds numbers", f"```python\n{ok}def (\n```"), ("s", 3, None, "x"), ("s", 4, "Write a function that adds numbers", None)]
    df = spark.createDataFrame(rows, "source string, ord int, prompt string, response string")
    got = {r.ord: r.drop_reason for r in filters.with_syntax(filters.with_gate(df)).collect()}
    assert got == {1: None, 2: "unparseable", 3: "empty", 4: "empty"}


@pytest.mark.parametrize("seed", range(4))
def test_capped_first_wins_is_the_sequential_loop(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "c"]
    rows = [(r.choice(names), i, f"h{r.randrange(25)}", r.random() < 0.2) for i in range(120)]
    cap, seen, want = r.randrange(1, 12), set(), {}
    for s in names:
        kept = 0
        for source, o, shape, leak in rows:
            if source != s:
                continue
            if kept >= cap:
                want[o] = "source_cap"
            elif shape in seen:
                want[o] = "near_duplicate"
            elif leak:
                want[o] = "benchmark_leak"
            else:
                want[o] = None
                seen.add(shape)
                kept += 1
    df = spark.createDataFrame(rows, "source string, ord int, shape string, leak boolean")
    assert {x.ord: x.drop_reason for x in dedup.capped_first_wins(df, cap, names).collect()} == want


def test_leaks_need_the_name_and_the_words(spark):
    tasks = spark.createDataFrame([("add", "## Task\nadd two numbers a and b\n\n## Solution\n"), ("mul", "?!")], "entry_point string, prompt string")
    rows = spark.createDataFrame([(1, "please add two numbers a and b now", "def add(): 1"), (2, "please add two numbers a and b", "def other(): 1"), (3, "unlike words", "def add(): 1"), (4, "x", "def mul(): 1")], "k int, prompt string, code string")
    assert [r.k for r in dedup.leaks(rows, dedup.benchmark_index(tasks), "k").collect()] == [1]


def test_many_rows_meet_only_the_problems_that_share_rare_words(spark):
    r = random.Random(5)
    some = lambda n: [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(n)]
    problems = [(f"f{i % 3}", some(r.randint(1, 40))) for i in range(150)]
    texts = [some(r.randint(1, 60)) if i % 3 else problems[i % 150][1][: r.randint(1, 40)] + some(r.randint(0, 9)) for i in range(300)] + [[], ["?"]]
    index = spark.createDataFrame([(e, list(dict.fromkeys(w))) for e, w in [*problems, *problems[:30], ("f0", []), (None, ["w1"])]], "entry_point string, bench_words array<string>")
    rows = spark.createDataFrame([(i, " ".join(w), f"def f{i % 3}(): 1\ndef f{i % 2}(): 2") for i, w in enumerate(texts)], "k int, prompt string, code string")
    for threshold in (0.3, 0.7, 1.0):
        want = {}
        for i, w in enumerate(texts):
            for e, b in problems:
                a, b = set(w) - {"?"}, set(b)
                if a and e in (f"f{i % 3}", f"f{i % 2}") and (ratio := len(a & b) / min(len(a), len(b))) >= threshold:
                    want[i] = max(ratio, want.get(i, 0))
        assert dict(map(tuple, dedup.leaks(rows, index, "k", threshold=threshold, few=10).collect())) == want and 20 < len(want) < 302
    sets = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    ours = spark.createDataFrame([("f", [f"x{i}", f"y{i}", "a", "b", "c", "d"]) for i in range(40)], "entry_point string, w array<string>")
    met = dedup.candidates(sets(ours, "__a"), sets(ours, "__b"), 0.7)
    assert met.count() == 40  # each its own, of 1,600 pairs


def test_rows_without_a_shape_are_not_joined(spark):
    rows = spark.createDataFrame([("a", 1, None, False), ("a", 2, "x", False), ("b", 3, "x", False), ("c", 4, None, False)], "source string, ord int, shape string, leak boolean")
    out = dedup.capped_first_wins(rows, None, ["a", "b"])
    assert {r.ord: r.drop_reason for r in out.collect()} == {1: None, 2: None, 3: "near_duplicate", 4: "unknown_source"}


def brute_pass(n, c, k):
    return 1.0 if n - c < k else 1.0 - math.prod(1.0 - k / i for i in range(n - c + 1, n + 1))


def test_pass_at_k_is_its_formula_and_monotone(spark):
    rows = [(n, c) for n in range(1, 12) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n int, c int")
    got = df.select("n", "c", *(N.pass_at_k(F.col("n"), F.col("c"), k).alias(f"p{k}") for k in (1, 2, 5))).collect()
    for r in got:
        for k in (1, 2, 5):
            assert abs(r[f"p{k}"] - brute_pass(r.n, r.c, k)) < 1e-12
        assert r.p1 <= r.p2 + 1e-12 <= r.p5 + 2e-12
        assert abs(r.p1 - r.c / r.n) < 1e-12


def test_summary_of_nothing_and_of_repeats(spark):
    schema = "task_id string, sample int, outcome string, parses boolean"
    assert stats.summary(spark.createDataFrame([], schema)).count() <= 1
    df = spark.createDataFrame([("a", 0, "PASS", True)] * 3 + [("a", 1, "FAIL", True)], schema)
    assert stats.per_task(df).first().n == 4 and stats.per_task(df, dedupe=True).first().n == 2


def test_pairs_take_the_shortest_pass_and_the_nearest_other(spark):
    rows = [("t", "p", i, c, o) for i, (c, o) in enumerate([("xxxx", "PASS"), ("yy", "PASS"), ("zz", "PASS"), ("aaaaa", "FAIL"), ("b", "ERROR"), ("ccc", "FAIL")])] + [("u", "p", 0, "q", "PASS"), ("v", "p", 0, "q", "FAIL")]
    df = spark.createDataFrame(rows, "task_id string, prompt string, sample int, code string, outcome string")
    (pair,) = preferences.pairs(df).collect()
    assert "yy" in pair.chosen and "\nb\n" in pair.rejected
    assert preferences.flat(preferences.groups(df)).count() == len(rows)


def test_splits_are_disjoint_and_guarded(spark):
    df = mix.ranked(spark.range(500).withColumnRenamed("id", "ord"), "ord")
    assert [r.n for r in df.orderBy("ord").select("n").collect()] == list(range(500))
    counts = {r.split: r["count"] for r in mix.positional_split(df, 100, 50, 10).groupBy("split").count().collect()}
    assert counts == {"tasks": 100, "validation": 50, "train": 350}
    with pytest.raises(ValueError):
        mix.positional_split(df, 400, 100, 10)
    assert abs(sum(s.weight for s in SOURCES) - 1) < 1e-9


def test_sandbox_is_off_and_classifies(spark):
    df = spark.createDataFrame([("t", 0, "x = 1", "assert x == 1", None)], "task_id string, sample int, code string, test_code string, setup_code string")
    with pytest.raises(PermissionError):
        sandbox.run_candidates(df)
    cases = {"x = 1": "PASS", "x = 2": "FAIL", "x = (": "SYNTAX_ERROR", "y = 1": "NAME_ERROR", "import sys; x = 1; sys.exit(0)": "ERROR", "x = 1 / 0": "ERROR", "while True: pass": "TIMEOUT"}
    for code, want in cases.items():
        assert sandbox.run_one(code, "assert x == 1", timeout=2)[0] == want, code
    assert sandbox.run_candidates(df, allow_untrusted_code=True).first().outcome == "PASS"


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_ranked_numbers_are_those_of_a_sort(spark, buckets):
    r = random.Random(buckets)
    rows = [(i, r.choice("ab"), r.choice([0, 0, 0, 5, r.randrange(10**6), None]), f"{r.randrange(99):x}") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, k int, s string").repartition(4)
    least = lambda k: -1 if k is None else k
    for order, key in ((["k", "i"], lambda x: (least(x[2]), x[0])), (["s", "i"], lambda x: (x[3], x[0]))):
        want = {x[0]: n for n, x in enumerate(sorted(rows, key=key))}
        assert {x.i: x.n for x in mix.ranked(df, order, buckets=buckets).collect()} == want
        own = {x[0]: n for g in "ab" for n, x in enumerate(sorted((x for x in rows if x[1] == g), key=key))}
        assert {x.i: x.n for x in mix.ranked(df, order, by=["g"], buckets=buckets).collect()} == own
    assert mix.ranked(df.limit(0), "k").count() == 0


def test_probe_counts_tasks_not_samples(spark):
    """Two of three tasks pass, one of them always: whatever the samples, the yield is 2/3."""
    rows = [("a", i, "PASS" if i == 0 else "FAIL") for i in range(100)] + [("b", i, "PASS") for i in range(3)] + [("c", 0, "ERROR")]
    df = spark.createDataFrame(rows, "task_id string, sample int, outcome string")
    r = stats.probe_report(df, 1000, 36.0).first()
    assert (r.tasks, round(r.rft_yield, 3), round(r.pair_yield, 3), round(r.all_pass, 3), round(r.all_fail, 3)) == (3, 0.667, 0.333, 0.333, 0.333)
    assert round(r.projected_pairs, 6) == 333.333333 and r.seconds == 36 and abs(r.projected_hours - 36 / 3 * 1000 / 3600) < 1e-9 and r.decision == "proceed"
    assert stats.probe_report(df, 800).first().decision == "defer" and stats.probe_report(df, 800).first().seconds is None
    assert stats.probe_report(df.where("task_id = 'c'"), 800).first().decision == "stop"


def test_prose_leaves_blank_ends_out(spark):
    rows = [("s", "  abcd\n\n", "ab", None), ("s", "x", "y", "empty"), ("s", "z", "z", "source_cap")]
    r = stats.source_stats(spark.createDataFrame(rows, "source string, response string, code string, drop_reason string")).first()
    assert (r.seen, r.kept, r.response_chars, r.code_chars, r.prose) == (2, 1, 4, 2, 0.5)


def test_sources_that_are_not_in_the_order_have_a_reason(spark):
    rows = [("a", 1, "x", False), ("b", 2, "x", False), (None, 3, "x", False), ("a", 4, None, False), ("a", 5, None, True)]
    df = spark.createDataFrame(rows, "source string, ord int, shape string, leak boolean")
    for cap in (None, 0, 9):
        got = {r.ord: r.drop_reason for r in dedup.capped_first_wins(df, cap, ["a"]).collect()}
        assert got == {1: None, 2: "unknown_source", 3: "unknown_source", 4: None, 5: None}
    assert {r.ord: r.drop_reason for r in dedup.capped_first_wins(df, 1, ["a"]).collect()}[4] == "source_cap"


def sequential_build(rows, order, index, gates):
    """The build as a loop, pair by pair."""
    found, shapes = {}, set()
    for source in order:
        kept = 0
        for s, o, prompt, response in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            if kept >= gates.per_source:
                found[o] = "source_cap"
                continue
            prompt, response = prompt.strip(), response.strip()
            blocks = re.findall(r"```([-+_0-9A-Za-z]*)[\t ]*\n(.*?)```", response, re.S)
            code = blocks[0][1].strip("\n") if blocks else ""
            names, words = set(re.findall(r"(?m)^\s*def\s+([_A-Za-z]\w*)", code)), set(re.findall("[a-z0-9_]+", prompt.lower()))
            shape = P.shape_of(code)
            if not prompt or not response:
                found[o] = "empty"
            elif not gates.prompt[0] <= len(prompt) <= gates.prompt[1]:
                found[o] = "prompt_length"
            elif prompt.lower().startswith("what is") or "function" not in prompt:
                found[o] = "not_a_code_request"
            elif not blocks:
                found[o] = "no_fenced_block"
            elif len(blocks) > 1:
                found[o] = "multi_block"
            elif blocks[0][0].lower() not in ("", "py", "python", "python3"):
                found[o] = "not_python"
            elif not gates.code[0] <= len(code) <= gates.code[1]:
                found[o] = "code_length"
            elif len(prompt) + len(code) > gates.pair:
                found[o] = "pair_too_long"
            elif shape is None:
                found[o] = "unparseable"
            elif shape in shapes:
                found[o] = "near_duplicate"
            elif any(name in names and w and len(words & set(w)) / min(len(words), len(w)) >= gates.leak for name, w in index):
                found[o] = "benchmark_leak"
            else:
                found[o] = None
                kept += 1
                shapes.add(shape)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_the_build_is_the_sequential_loop(spark, seed):
    r = random.Random(seed)
    index = [("f1", ["add", "two", "numbers", "function", "write"]), ("f2", ["sort"])]

    def pair(i):
        prompt = r.choice(["Write a function that adds numbers", "write a function: add two numbers", " ", "What is a function in full?", "Tell me something, please, now", "function", "Write a function to sort a list"])
        n = r.randrange(1, 5)
        body = f"def f{r.randrange(4)}(x):\n" + f"    x = x + {i} * 1000000\n" * n + "    return x\n" + "# a comment to be long enough, so that it is\n"
        body = r.choice([body] * 8 + ["x = 1\n", "def (\n" + "#" * 70 + "\n"])
        block = f"```{r.choice(['python', 'Py', '', 'rust'])}\n{body}```"
        return prompt, r.choice([block] * 6 + [body, block + block, " ", f"  {block}\n"])

    rows = [(r.choice("abc"), i, *pair(i)) for i in range(250)]
    for cap in (2, 1000):
        gates = filters.Gates(per_source=cap)
        df = spark.createDataFrame(rows, "source string, ord int, prompt string, response string")
        problems = spark.createDataFrame(index, "entry_point string, bench_words array<string>")
        got = {x.ord: x.drop_reason for x in builds.filtered_pairs(df, ["b", "c", "a"], problems, gates).collect()}
        assert got == sequential_build(rows, "bca", index, gates)


def test_ranked_by_strings_of_one_beginning(spark):
    """Keys that share their beginning, and prefixes that most rows have, are still parted."""
    keys = [f"doc_{i:08d}" for i in range(3000)] + [f"doc_0000{'x' * 30}{i}" for i in range(40_000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    assert {r.k: r.n for r in mix.ranked(df, "k").collect()} == {k: n for n, k in enumerate(sorted(keys))}
    parts = df.select(mix._prefixes(df, "k", 256).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert parts <= 12_000


def test_evaluation_goes_on_where_it_was_broken_off(spark, tmp_path):
    """Half of the samples are on disk, the last line torn; what is missing is made once, by a generator that counts, and all is summed up."""
    tasks = spark.createDataFrame([(f"t{i}", f"p{i}", f"assert x == {i}", "") for i in range(4)], "task_id string, prompt string, test_code string, setup_code string")
    asked = []

    def generate(work):
        asked.extend(sorted((r.task_id, r.sample) for r in work.collect()))
        value = F.when(F.col("sample") % 2 == 0, F.substring("task_id", 2, 9)).otherwise("9")
        return work.withColumn("completion", F.concat(F.lit("Sure:\n```python\nx = "), value, F.lit("\n```")))

    run = lambda rows: sandbox.run_candidates(rows, allow_untrusted_code=True, timeout=20)
    path = tmp_path / "r"
    path.mkdir()
    whole = [{"task_id": t, "sample": s, "outcome": "PASS", "detail": "", "parses": True, "code": "x"} for t in ("t0", "t1") for s in range(3)]
    (path / "0.json").write_text("\n".join(map(json.dumps, whole)) + "\n" + json.dumps(whole[0] | {"task_id": "t2"})[:40])
    r = evaluation.evaluate(tasks, generate, run, str(path), samples=3).first()
    assert asked == [(f"t{i}", s) for i in (2, 3) for s in range(3)]
    assert (r.tasks, r.samples, r.solved, r.parse_rate) == (4, 12, 4, 1.0) and abs(r.pass_at_1 - (1 + 1 + 2 / 3 + 2 / 3) / 4) < 1e-9 and "pass_at_5" not in r.asDict()
    asked.clear()
    assert evaluation.evaluate(tasks, generate, run, str(path), samples=3).first().samples == 12 and not asked

    labels = str(tmp_path / "g")
    bare = lambda work: generate(work).withColumn("completion", T.extract_code(F.col("completion")))
    first = evaluation.sample_and_label(tasks.where("task_id < 't2'"), bare, run, labels, samples=2)
    assert first.count() == 2
    asked.clear()
    both = {g.task_id: g for g in evaluation.sample_and_label(tasks, bare, run, labels, samples=2).collect()}
    assert asked == [(f"t{i}", s) for i in (2, 3) for s in range(2)] and both.keys() == {"t0", "t1", "t2", "t3"}
    assert [(s.code, s.outcome) for s in both["t2"].samples] == [("x = 2", "PASS"), ("x = 9", "FAIL")] and both["t2"].prompt == "p2"


def test_streams_are_two_bytes_an_id(spark):
    from corpuskit.operators import examples

    df = spark.createDataFrame([(i, [i, 65_535 - i] * (i % 3)) for i in range(50)], "ord int, ids array<int>").repartition(4)
    rows = examples.stream(df).collect()
    flat = b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.ord))
    want = [x for i in range(50) for x in [i, 65_535 - i] * (i % 3)]
    assert list(struct.unpack(f"<{len(want)}H", flat)) == want
    for r in rows:
        assert flat[2 * r["first"] : 2 * (r["first"] + r.n)] == bytes(r.data)
    with pytest.raises(Exception, match="65,536"):
        examples.stream(spark.createDataFrame([(1, [65_536])], df.schema)).collect()
