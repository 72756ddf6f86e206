from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm import near_dedup as nd
from corpuskit.llm._text import shingles, word_hashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.integers(0, 30))
def test_banded_distance_is_the_full_one_within_the_band(a, b, most):
    full = distance(a, b)
    assert nd.banded_distance(a, b, most) == (full if full <= most else most + 1)


def test_banded_distance_of_edited_sequences():
    r = random.Random(3)
    for _ in range(60):
        a = [r.randrange(50) for _ in range(r.randrange(1, 200))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randrange(10)):
            b.insert(r.randrange(len(b) + 1), r.randrange(50))
        most = r.randrange(0, 60)
        assert nd.banded_distance(a, b, most) == min(distance(a, b), most + 1)


def test_hashes_do_not_depend_on_the_batch():
    texts = ["Thé cat, sat on\0the mat", "", None, "one", "a b c d e " * 9, "x"]
    words, at = word_hashes(texts)
    for i, t in enumerate(texts):
        assert (word_hashes([t])[0] == words[at[i] : at[i + 1]]).all()
    kmers, at = shingles(words, at, 3)
    assert list(np.diff(at)) == [4, 0, 0, 1, 43, 1]
    alone = [nd.order_sketches([t])[0] for t in texts]
    together = nd.order_sketches(texts)[0]
    assert (np.concatenate([x for x in alone if len(x)]) == together).all()


def brute_sketch(text, k, ell, s):
    """The sketch by its definition: labelled k-mers sorted by hash, the least kept in text order."""
    words, at = word_hashes([text])
    kmers, at = shingles(words, at, k)
    labelled = nd._labelled(kmers, at)
    rank = sorted(range(len(kmers)), key=lambda i: (int((labelled[i : i + 1] * nd._MULTIPLIERS[s])[0]) >> 24, i))[:ell]
    return [int(labelled[i]) for i in sorted(rank)]


def test_sketches_are_the_least_in_text_order():
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 60))) for _ in range(20)]
    got = nd.order_sketches(texts, 2, 3, 4)[0]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            for s in range(4):
                assert (got[i, s] == got[j, s]) == (brute_sketch(a, 2, 3, s) == brute_sketch(b, 2, 3, s))


def test_order_matters():
    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join(a.split()[20:] + a.split()[:20])
    same = (nd.order_sketches([a], 1, 4, 64)[0] == nd.order_sketches([b], 1, 4, 64)[0]).mean()
    assert same < 0.5  # the same set of words: a MinHash would agree on all


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    docs, passage = [], " ".join(word() for _ in range(55))
    for _ in range(30):
        base = [word() for _ in range(r.randrange(8, 200))]
        docs.append(" ".join(base))
        for _ in range(r.randrange(4)):
            docs.append(" ".join(w if r.random() > 0.06 else word() for w in base))
    docs += [" ".join(word() for _ in range(300)) + " " + passage for _ in range(10)]
    return docs + [docs[0], docs[0].upper(), "", "", None, None, "!!!", "!!!", "?", "solo", "Solo."]


def test_groups_are_those_of_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, "x"), (None, "x")], "doc_id bigint, text string")
    got = {r.doc_id: r.group_id for r in nd.groups(df).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if a is None or b is None:
                continue
            wa, wb = word_hashes([a])[0].tolist(), word_hashes([b])[0].tolist()
            if (wa or wb) and bool(wa) == bool(wb):
                same = distance(wa, wb) <= int(0.25 * max(len(wa), len(wb)) + 1e-9)
            else:
                same = a == b
            if same:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = {i: root(i) for i in range(len(texts))}
    assert got == want


def test_deduplicate_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f g h", 5), (2, "a b c d e f g h", 6), (2, "a b c d e f g h", 6), (3, "z", 7), (3, "z", 7), (None, "z", 8), (4, None, 9), (5, None, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep int")
    out = nd.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.rep) for r in out.collect()) == [(0, 8), (1, 5), (3, 7), (4, 9), (5, 9)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, id string, root int, key int, a int")
    assert nd.groups(df).count() == 0
    assert nd.deduplicate(df).columns == df.columns
    full = spark.createDataFrame([(1, "p q r s", "u", 1, 2, 3), (2, "p q r s", "v", 1, 2, 3)], df.schema)
    assert [r.doc_id for r in nd.deduplicate(full).collect()] == [1]


def test_hot_buckets_are_refined(spark, monkeypatch):
    """Many documents share a passage, and some of them are copies: they are found although the buckets are larger than a leaf."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        own = [word() for _ in range(r.randrange(40, 90))]
        texts.append(" ".join(own + passage))
        if i % 3 == 0:
            texts.append(" ".join(w if r.random() > 0.05 else word() for w in own + passage))
    base = [word() for _ in range(80)]
    texts += [" ".join(w if r.random() > 0.03 else word() for w in base) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(nd, "LEAF", 6)
    got = {x.doc_id: x.group_id for x in nd.groups(df).collect()}
    for i in range(80):
        for j in range(i):
            if nd.similar(texts[i], texts[j]):
                assert got[i] == got[j]
    assert len({got[i] for i in range(80, 120)}) == 1 and len(set(got.values())) == 61


def test_copies_are_found_in_buckets_that_stay_hot(spark):
    """Hundreds of documents are mostly a shared passage and some are edited copies of each other; beside them is a template family."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    edited = lambda words, by: [w if r.random() > by else word() for w in words]
    passage = [word() for _ in range(90)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(50)]
        texts += [" ".join(own[:25] + passage + own[25:]), " ".join(edited(own[:25], 0.3) + edited(passage, 0.1) + edited(own[25:], 0.3))]
    template = [word() for _ in range(60)]
    texts += [" ".join(edited(template, 0.1)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.group_id for x in nd.groups(df).collect()}
    copies = [i for i in range(0, 300, 2) if nd.similar(texts[i], texts[i + 1])]
    assert len(copies) > 50 and sum(got[i] == got[i + 1] for i in copies) >= 0.9 * len(copies)
    # Both of every pair that agrees on a sketch are in one group, if they are similar.
    sketches = nd.order_sketches(texts)[0]
    for i in range(300):
        for j in np.nonzero((sketches[:i] == sketches[i]).any(axis=1))[0].tolist():
            assert got[i] == got[j] or not nd.similar(texts[i], texts[j])
    assert sum(got[i] == got[300] for i in range(300, 1800)) >= 0.99 * 1500


def test_lengths_within_the_threshold_share_a_class(spark, monkeypatch):
    """In a hot bucket, a truncated copy is held against the least id of the group."""
    r = random.Random(6)
    monkeypatch.setattr(nd, "LEAF", 2)
    cases = [(100, 78), (100, 80), (1000, 800), (100, 75), (4, 3)] + [(n, -(-3 * n // 4)) for n in r.sample(range(5, 5000), 100)]
    rows = [(3 * c + at, n, [c]) for c, (long, short) in enumerate(cases) for at, n in enumerate((long, long, short))]
    stars = nd._candidates(spark.createDataFrame(rows, "id bigint, words bigint, sketches array<bigint>"), 1, 0.75)[0]
    assert {tuple(x) for x in stars.collect()} == {(3 * c, 3 * c + at) for c in range(len(cases)) for at in (1, 2)}


def test_truncated_copies_in_a_hot_group(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    base = [word() for _ in range(100)]
    texts = [" ".join(w if r.random() > 0.01 else word() for w in base) for _ in range(150)] + [" ".join(base[:n]) for n in (78, 80, 85)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {x.group_id for x in nd.groups(df).collect()} == {0}


def test_recall_of_candidates_at_the_threshold():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    hit = tried = 0
    for n in (40, 200, 800):
        a = [[r.choice(vocabulary) for _ in range(n)] for _ in range(60)]
        b = [[w if r.random() > 0.18 else r.choice(vocabulary) for w in x] for x in a]
        sa, sb = (nd.order_sketches([" ".join(x) for x in t])[0] for t in (a, b))
        for i in range(60):
            if nd.similar(" ".join(a[i]), " ".join(b[i])):
                tried += 1
                hit += (sa[i] == sb[i]).any()
    assert tried > 100 and hit / tried > 0.95


def test_very_long_texts_hash_like_short_ones(monkeypatch):
    from corpuskit.llm import _text

    text = " ".join(f"word{i} Ünd" for i in range(500))
    whole = word_hashes([text])[0]
    monkeypatch.setattr(_text, "PIECE_CHARS", 100)
    assert (word_hashes([text])[0] == whole).all() and word_hashes([text])[1].tolist() == [0, 1000]
    for long in ("a" * 1000, "q " + "ab" * 2500 + " r", "漢" * 1000):
        monkeypatch.setattr(_text, "PIECE_CHARS", 10**6)
        whole = word_hashes([long])[0]
        monkeypatch.setattr(_text, "PIECE_CHARS", 100)
        assert (word_hashes([long])[0] == whole).all()
    assert word_hashes(["a" * 4096 + "b" + "c" * 4095 + "d"])[0] != word_hashes(["a" * 4096 + "d" + "c" * 4095 + "b"])[0]


def test_words_of_scripts_without_spaces():
    from corpuskit.llm._text import scan

    def words(text):
        data, starts, ends, _ = scan([text])
        return [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]

    assert words("Hello wörld, 你好。世界abc「日本」！x") == ["hello", "wörld", "你", "好", "世", "界", "abc", "日", "本", "x"]
    assert words("สวัส a 한국어 단어") == [*"สวัส", "a", "한국어", "단어"] and words("no\u3000way—ok") == ["no", "way—ok"]


def test_unspaced_very_long_and_many_copies(spark):
    """Texts of one long run, long texts, and one text that most rows have; links count copies and similar texts."""
    r = random.Random(12)
    run = [chr(0x4E00 + r.randrange(5000)) for _ in range(2000)]
    long = [f"w{r.randrange(9000)}" for _ in range(150_000)]
    texts = ["".join(run), "".join(run[:1000] + ["好"] + run[1001:]), " ".join(long), " ".join(long[:100] + long[5000:]), "x" * 2_500_000, "x" * 2_500_000 + "y"]
    rows = [*enumerate(texts), *((i, "Nothing to see on this page") for i in range(100, 20_100)), (30_000, "Nothing to see on this page today")]
    got = {x.doc_id: (x.group_id, x.kept, x.links) for x in nd.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == (0, True, 1) and got[1] == (0, False, 1) and got[2] == (2, True, 1) and got[3] == (2, False, 1)
    assert got[4] == (4, True, 0) and got[5] == (5, True, 0)
    assert got[100] == (100, True, 20_000) and all(got[i] == (100, False, 20_000) for i in range(101, 20_100)) and got[30_000] == (100, False, 1)
