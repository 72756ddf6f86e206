from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from corpuskit.llm import fingerprints as fp


def brute(text, k, fraction):
    w = [x for x in (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
    s = {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
    digests = (hashlib.md5(x.encode()).hexdigest() for x in s)
    return sorted({int(d[:15], 16) for d in digests if fraction >= 1 or int(d[:15], 16) < int(fraction * 16**15)})


def test_sketches_and_containment_are_those_of_brute_force(spark):
    r = random.Random(1)
    big = [f"w{r.randrange(3000)}" for _ in range(4000)]
    texts = [" ".join(big), " ".join(big[100:400]), " ".join(big[:50] + [f"v{i}" for i in range(50)]), "Tiny\ttext\n", "", None, "  ", "one two three four five"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n int, id string")
    for fraction in (1.0, 1 / 8):
        got = {x.doc_id: x for x in fp.in_corpus(df, fraction=fraction).collect()}
        all_ = {i: brute(t, 5, fraction) for i, t in enumerate(texts)}
        for i, own in all_.items():
            assert got[i].sketch == own
            rest = set().union(*(set(v) for j, v in all_.items() if j != i))
            assert got[i].shared == len(rest & set(own)) and got[i].containment == (len(rest & set(own)) / len(own) if own else None)
    exact = fp.sketches(df, fraction=1.0).where("doc_id < 3").select(F.collect_list(F.struct("doc_id", "sketch"))).first()[0]
    sets = {x.doc_id: set(x.sketch) for x in exact}
    a, b = (fp.sketches(df, fraction=1 / 4).where(f"doc_id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in (1, 0))
    got = a.crossJoin(b).select(fp.containment(F.col("s1"), F.col("s0")).alias("c"), fp.merge(F.col("s1"), F.col("s0")).alias("m")).first()
    assert abs(got.c - len(sets[1] & sets[0]) / len(sets[1])) < 0.1
    assert got.m == sorted(set(brute(texts[0], 5, 1 / 4)) | set(brute(texts[1], 5, 1 / 4)))


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g"), (None, "a b c d e f"), (None, "z")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in fp.in_corpus(df, fraction=1.0).collect()}
    assert got[1].n_shingles == 5 and len(got[1].sketch) == 3 and got[1].shared == 2 and got[None].shared == 2 and got[None].n_shingles == 3
    assert fp.in_corpus(df.limit(0)).count() == 0


def test_containers_are_those_of_brute_force(spark):
    """A passage that most documents have, some of which consist of it, beside parts of long documents and copies."""
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    long = [f"w{r.randrange(900)}" for _ in range(3000)]
    texts = [" ".join(long), " ".join(long[100:180]), " ".join(long[100:180] + long[900:960]), passage, passage, f"{passage} more", "", None, "one"]
    texts += [passage + " " + " ".join(f"u{i}x{j}" for j in range(r.choice([10, 60, 90]))) for i in range(60)] + ["two words"] * 5
    df = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (None, passage, 1)], "doc_id bigint, text string, c int")
    sets = {i: frozenset(brute(t, 5, 1.0)) for i, t in enumerate(texts)}
    for every in (1, 3):
        want = set()
        for q, a in sets.items():
            for b in set(sets.values()) if a and q % every == 0 else ():
                same = sorted(i for i, x in sets.items() if x == b)
                copies = len(same) - (a == b)
                if b and copies and max(len(a & b) / len(a), len(a & b) / len(b)) >= 0.5:
                    want.add((q, same[0], copies, len(a & b), round(len(a & b) / len(a), 9), round(len(a & b) / len(b), 9)))
        got = {(x.doc_id, x.match, x.copies, x.shared, round(x.containment, 9), round(x.contained, 9)) for x in fp.containers(df, F.col("id") % every == 0, fraction=1.0).collect()}
        assert got == want and any(x[4] < 0.1 and x[5] == 1 for x in want)
    assert fp.containers(df.limit(0), F.lit(True)).count() == 0


def test_a_very_long_text_is_sketched_whole(spark):
    words = [f"w{i * 7919 % 60_000}" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[-300:]))], "doc_id bigint, text string")
    got = {x.doc_id: x.sketch for x in fp.sketches(df).collect()}
    assert got[1] == brute(" ".join(words), 5, fp.FRACTION) and set(got[2]) <= set(got[1])
