from __future__ import annotations

import random

import numpy as np
import pytest

from corpuskit.llm import toxicity as tx


def word(r):
    return "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))


def labelled(n, seed=0):
    """Texts of invented words; toxic ones have one to three forms of two stems somewhere in them."""
    r = random.Random(seed)
    vocabulary = [word(r) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 150))]
        bad = i % 4 == 0
        for _ in range(r.randrange(1, 4) if bad else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(["zorgum", "quaxil"]) + r.choice(["", "en", "ius", word(r)]))
        texts.append(" ".join(words))
        toxic.append(bad)
    return texts, toxic


@pytest.fixture(scope="module")
def net():
    return tx.fit(*labelled(800), steps=420)


def test_held_out_accuracy(net):
    texts, toxic = labelled(400, seed=9)
    found = net.score_texts(texts)[0] >= 0.5
    truth = np.array(toxic)
    assert (found & truth).sum() >= 0.97 * truth.sum() and (found & ~truth).sum() <= 0.02 * (~truth).sum()


def test_whole_texts_are_scored(net):
    clean = " ".join(labelled(40, seed=3)[0][1:4]) + " "
    long = clean * 60
    assert net.score_texts([long])[0][0] < 0.5
    for at in (0, len(long) // 2, len(long)):
        cut = long.find(" ", at) if at < len(long) else at
        assert net.score_texts([long[:cut] + " zorgumen " + long[cut:]])[0][0] >= 0.5
    assert net.score_texts(["bada " * 500])[0][0] < 0.5


def test_windows_cover_every_word():
    for n in (1, 5, 31, 32, 33, 48, 49, 64, 100, 1000):
        text, start, words = tx.windows(np.array([0, 0, n]))
        assert (text == 1).all() and set().union(*(range(a, a + w) for a, w in zip(start, words, strict=True))) == set(range(n))
        assert (np.diff(start) <= tx.STRIDE).all() and len(start) == (1 if n <= 32 else -(-(n - 32) // 16) + 1)


def test_scores_do_not_depend_on_the_batch(net):
    texts = labelled(60, seed=4)[0] + ["", "!!"]
    together, n = net.score_texts(texts)
    alone = [net.score_texts([t])[0][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and list(n[-2:]) == [0, 0] and list(together[-2:]) == [0, 0]


def test_gradients_are_those_of_finite_differences():
    r = np.random.default_rng(0)
    net = tx.Network(3)
    for k in net.p:
        net.p[k] = (net.p[k] + (0.1 * r.standard_normal(net.p[k].shape) if k != "gram" else 0)).astype(np.float32)
    f = tx.Features([" ".join(f"w{i % 13}x" for i in range(50)), "short one"])
    _, start, words = tx.windows(f.offsets)
    valid = np.arange(tx.WINDOW) < words[:, None]
    index = np.where(valid, f.words[np.minimum(start[:, None] + np.arange(tx.WINDOW), len(f.words) - 1)], f.n)
    y, w = np.arange(len(start), dtype=np.float32) % 2, np.ones(len(start), dtype=np.float32)
    _, g = net.gradients(f, index, valid, y, w)
    for k in ("inp", "fwd", "bwd", "att", "att_v", "out", "bias"):
        flat, j = net.p[k].reshape(-1), int(np.abs(g[k]).reshape(-1).argmax())
        was = flat[j]
        flat[j] = was + 0.01
        up = net.gradients(f, index, valid, y, w)[0]
        flat[j] = was - 0.01
        down = net.gradients(f, index, valid, y, w)[0]
        flat[j] = was
        assert abs((up - down) / 0.02 - g[k].reshape(-1)[j]) < 0.02 * abs(g[k].reshape(-1)[j]) + 2e-4


def test_best_cut():
    assert tx.best_cut(np.array([1.0, 2, 8, 9]), np.array([False, False, True, True])) == 5
    assert tx.best_cut(np.array([1.0, 2]), np.array([True, True])) == 0


def test_queries_over_tables(spark):
    texts, toxic = labelled(700, seed=5)
    rows = [(i, t, 5, "s") for i, t in enumerate(texts)] + [(None, "x", 1, "s"), (9000, None, 1, "s"), (9001, "", 1, "s"), (7, texts[7], 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int, scored string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)] + [(None, 1, 1), (3, 1, None), (4000, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = tx.scores(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[9000].score is None and not by[9000].toxic and (by[9001].score, by[9001].windows) == (0.0, 0)
    assert np.mean([by[i].toxic == b for i, b in enumerate(toxic)]) > 0.9
    kept = tx.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out)
    assert tx.scores(docs, labels.limit(0)).where("score > 0 or toxic").count() == 0
    assert tx.scores(docs.limit(0), labels).count() == 0


def test_very_long_texts_are_scored_whole(net, monkeypatch):
    from corpuskit.llm import _text

    clean = " ".join(labelled(40, seed=3)[0][1:4]) + " "
    monkeypatch.setattr(_text, "PIECE_CHARS", 400)
    long = (clean * 20).strip()
    assert "".join(_text.segments(long)) == long and len(list(_text.segments(long))) > 10
    assert net.score_texts([long, clean])[0].max() < 0.5
    for part in (1, 5, 9):
        at = sum(map(len, list(_text.segments(long))[:part]))
        assert (net.score_texts(["x", long[:at] + " zorgumen" + long[at:], "y"])[0] >= 0.5).tolist() == [False, True, False]


def test_segments_have_the_windows_of_the_whole(monkeypatch):
    from corpuskit.llm import _text

    net = tx.Network(3)
    net.p["word"] = np.random.default_rng(0).standard_normal(net.p["word"].shape).astype(np.float32)
    words = " ".join(labelled(60, seed=3)[0]).split()
    for n in (0, 1, 31, 32, 33, 48, 49, 64, 65, 200, len(words)):
        text = " ".join(words[:n])
        monkeypatch.setattr(_text, "PIECE_CHARS", 10**6)
        score, count = net._score_piece([text])
        for most in (50, 100, 333, 1000):
            monkeypatch.setattr(_text, "PIECE_CHARS", most)
            got = net.score_texts(["x", text])
            assert got[1][1] == count[0] and abs(got[0][1] - score[0]) < 1e-6


def plain_score(net, words):
    """A window's log odds by loops, number by number."""
    p, h = net.p, tx.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = np.zeros((len(words), 2 * h))
    f = tx.Features([" ".join(words)])
    inputs = f.embed(p["word"], p["gram"]).astype(float)[f.words]
    for d, name in enumerate(("fwd", "bwd")):
        s = np.zeros(h)
        for t in range(len(words)) if d == 0 else reversed(range(len(words))):
            gate = lambda g, t=t, d=d: [sum(inputs[t][i] * p["inp"][i][(2 * g + d) * h + j] for i in range(inputs.shape[1])) + p["bias"][(2 * g + d) * h + j] for j in range(h)]
            back = lambda g, s=s, name=name: [sum(s[i] * p[name][i][g * h + j] for i in range(h)) for j in range(h)]
            z, r = sigmoid(np.add(gate(0), back(0))), sigmoid(np.add(gate(1), back(1)))
            s = (1 - z) * np.tanh(np.add(gate(2), r * np.array(back(2)))) + z * s
            states[t, d * h : (d + 1) * h] = s
    e = np.array([np.tanh(x @ p["att"].astype(float)) @ p["att_v"] for x in states])
    weight = np.exp(e) / np.exp(e).sum()
    return sum(w * (x @ p["out"]) for w, x in zip(weight, states, strict=True)) + p["out_b"][0]


def test_scores_are_those_of_a_plain_forward_pass(net):
    texts = labelled(8, seed=6)[0]
    for text in texts:
        words = text.split()
        starts = [*range(0, max(len(words) - tx.WINDOW, 0), tx.STRIDE), max(len(words) - tx.WINDOW, 0)]
        best = max(plain_score(net, words[a : a + tx.WINDOW]) for a in starts)
        assert abs(net.score_texts([text])[0][0] - 1 / (1 + np.exp(net.cut - best))) < 1e-4
