from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.config import Words
from corpuskit.operators import tokenizer as tk

CODE = "Text.\n```python\ndef f(x):\n    if x:\n        return 1\n\n    return None\n```\ndone"
DOCS = ["def self_x(self): return selfs", "it's 'data' İ 12ab  x\n\n  y", CODE, "naïve 🙂 ünï", "low lower lowest newest widest " * 5]


@pytest.fixture(scope="module")
def vocabulary(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS * 3)], "ord int, text string")
    return tk.train(df, 420)


def test_alphabet_and_registered_words():
    v = tk.Vocabulary.new()
    assert [v.ids[tk.BYTE_CHAR[b]] for b in range(256)] == list(range(256)) and len(set(tk.BYTE_CHAR.values())) == 256
    assert [v.ids[s] for s in Words().special] == list(range(256, 262))
    assert v.ids[tk.byte_chars("def")] + 1 == v.ids[tk.byte_chars(" def")] and tk.byte_chars("\n") in v.ids


def test_pretokens():
    cut = tk.Vocabulary.new()._cut.findall
    assert cut("self selfs self_x 'data'") == ["self", " selfs", " self", "_", "x", " '", "data", "'"] or cut("selfs") == ["selfs"]
    assert cut("self_x")[0] == "self" and "".join(cut("a  b\n\n c")) == "a  b\n\n c"
    assert cut("if x==1") == ["if", " x", "==", "1"]


def naive_merges(counts, n, known):
    """Recount everything each turn."""
    words = {w: [tk.BYTE_CHAR[b] for b in w.encode()] for w in counts}
    out = []
    for _ in range(n):
        pairs = Counter()
        for w, parts in words.items():
            for p in zip(parts, parts[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        words = {w: tk.merged(parts, best) for w, parts in words.items()}
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=8), st.integers(1, 9), max_size=12), st.integers(0, 25))
def test_merges_are_those_of_naive_counting(counts, n):
    v = tk.Vocabulary()
    tk.learn_merges(v, counts, 256 + n)
    assert list(v.ranks) == naive_merges(counts, n, v)


def test_distributed_counts_are_pythons(spark):
    r = random.Random(0)
    texts = DOCS + ["".join(r.choice("aB1 \n\t'-_é ") for _ in range(300)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for locked in ((), Words().locked):
        want = Counter(x for t in texts for x in tk.regex.compile(tk.split_pattern(locked), tk.regex.IGNORECASE).findall(t))
        assert {x.token: x.freq for x in tk.pretoken_counts(df, locked).collect()} == want


def test_round_trips(vocabulary, tmp_path):
    for t in [*DOCS[:2], *DOCS[3:]]:
        assert vocabulary.decode_plain(vocabulary.encode_plain(t)) == t
    assert vocabulary.decode(vocabulary.encode(CODE, add_eos=True)) == CODE
    vocabulary.save(tmp_path)
    again = tk.Vocabulary.load(tmp_path)
    assert again.ids == vocabulary.ids and again.ranks == vocabulary.ranks and again.special_ids == vocabulary.special_ids
    assert again.encode(CODE) == vocabulary.encode(CODE)


def test_locked_words_stay_whole(vocabulary):
    ids = vocabulary.encode_plain("self def")
    assert [vocabulary.tokens[i] for i in ids] == [tk.byte_chars("self"), tk.byte_chars(" def")]


def test_scopes():
    marked = tk.mark_scopes("def f():\n  if x:\n    y\n\n   z\nw")
    assert marked == f"def f():\n{tk.INDENT}if x:\n{tk.INDENT}y\n\n{tk.DEDENT} z\n{tk.DEDENT}w"
    assert tk.mark_scopes("a\n\tb") == f"a\n{tk.INDENT}b\n{tk.DEDENT}"
    assert tk.preprocess("no fence\n    x") == "no fence\n    x"
    assert tk.postprocess(f"a\n{tk.INDENT}b\n{tk.INDENT}{tk.DEDENT}\nc{tk.INDENT}<|fim_middle|>\nd{tk.EOS}e") == "a\n    b\n        c\n        d"
    assert tk.postprocess(f"{tk.DEDENT}{tk.DEDENT}x") == "x" and tk.postprocess("a\n\nb") == "a\n\nb"


def test_columns(spark, vocabulary):
    df = spark.createDataFrame([(0, DOCS[0]), (1, DOCS[1]), (2, ""), (3, DOCS[4])], "ord int, text string")
    direct = {r.ord: r.ids for r in df.select("ord", tk.encode_udf(vocabulary, plain=True)("text").alias("ids")).collect()}
    joined = {r.ord: r.ids for r in tk.encode_distinct(df, vocabulary).collect()}
    assert direct == joined and direct[2] == []
    whole = {r.ord: r.ids for r in tk.compile_corpus(df, vocabulary, fim_rate=0.0).collect()}
    assert all(whole[i] == direct[i] + [vocabulary.ids[tk.EOS]] for i in whole)
    moved = {r.ord: r.ids for r in tk.compile_corpus(df, vocabulary, fim_rate=1.0).collect()}
    marks = {vocabulary.ids[f"<|fim_{x}|>"] for x in ("prefix", "middle", "suffix")}
    assert all(sorted(moved[i]) == sorted([*whole[i], *(marks if len(direct[i]) >= 4 else ())]) for i in whole)
    ids, ranks = vocabulary.frames(spark)
    assert ids.count() == len(vocabulary.ids) and ranks.count() == len(vocabulary.ranks)


def test_examples_pairs_and_masks(spark, vocabulary):
    rows = spark.createDataFrame([(0, "ab ", "cd", "longer text here " * 9), (1, "ab ", "cd", "e")], "ord int, prompt string, chosen string, rejected string")
    e = tk.encode_examples(rows.withColumnRenamed("chosen", "completion"), vocabulary).collect()
    assert e[0].ids[: e[0].prompt_len] == vocabulary.encode("ab ") and e[0].ids[e[0].prompt_len :] == vocabulary.encode("cd")
    kept = tk.encode_pairs(rows, vocabulary, 10).collect()
    assert [r.ord for r in kept] == [1] and kept[0].chosen.prompt_len == len(vocabulary.encode("ab "))
    from corpuskit.operators.examples import masked_example
    from pyspark.sql import functions as F

    x = tk.encode_examples(rows.where("ord = 1").withColumnRenamed("chosen", "completion"), vocabulary).select(masked_example(F.col("ids"), F.col("prompt_len"), 16, vocabulary.ids[tk.EOS]).alias("e")).select("e.*")
    shown = tk.shown_mask(x, vocabulary).first()
    assert shown.prompt_text.startswith("ab") and shown.supervised_text == "cd"
    none = tk.shown_mask(x.withColumn("y", F.transform("y", lambda v: F.lit(-1))), vocabulary).first()
    assert none.supervised_text == "<empty>"


def test_a_text_is_encoded_once(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "")], "ord long, text string")
    made = tk.compile_corpus(docs, tk.Vocabulary.new(), fim_rate=0.0)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.ord: len(r.ids) for r in made.collect()} == {1: 6, 3: 1}


def test_what_is_kept_of_pre_tokens_is_bounded(monkeypatch):
    monkeypatch.setattr(tk, "KEPT_WORDS", 10)
    v = tk.Vocabulary.new()
    for i in range(100):
        v.encode(f"w{i} x")
        assert len(v._known) <= 10
    assert v.decode(v.encode("w1 x w2")) == "w1 x w2"


def test_many_texts_are_encoded_as_one_by_one(monkeypatch):
    v = tk.learn_merges(tk.Vocabulary.new(), {"aaaaaaa": 9, "abababa": 7, " the": 5, "then": 3, "é漢": 2}, 400)
    texts = ["aaaaaaaaaaa aaaa <|eos|> aaa<|indent|>x", "", "<|eos|>", "def self\n\n  the then é漢 " + "a" * 300, "<|eos|><|eos|>b", "abababababa ababa"]
    want = [v.encode_bytes(t) for t in texts]
    for most in (3, 100_000):
        monkeypatch.setattr(tk, "KEPT_WORDS", most)
        fresh = tk.Vocabulary(v.ids, v.ranks, v.special, v.special_ids, v.locked)
        assert fresh.encode_many(texts) == want == fresh.encode_many(texts)


def test_ids_are_handed_on_by_portions(monkeypatch):
    monkeypatch.setattr(tk, "BYTES_AT_A_TIME", 10)
    assert list(tk._portions(tk.np.array([4, 6, 1, 30, 0, 9, 2]))) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    v = tk.Vocabulary.new()
    got = tk.encode_udf(v).func(iter([tk.pa.array(["abcdefgh", None, "ij", "", "klmnopqrstuvwxyz"])]))
    assert [x.to_pylist() for x in got] == [[v.encode("abcdefgh"), None, v.encode("ij"), []], [v.encode("klmnopqrstuvwxyz")]]
    sides = tk.encode_sides_udf(v).func(iter([tk.pa.array([["ab", None], ["cdefghijkl", ""]])]))
    assert [x.to_pylist() for x in sides] == [[[v.encode("ab"), None]], [[v.encode("cdefghijkl"), []]]]
