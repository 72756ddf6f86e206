"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a hashed word embedding beside the scaled sum of embeddings of its character 3- and
5-grams, so that inflected and unseen forms still say something. Two gated recurrent passes, one in each
direction, run over every window of WINDOW words at each STRIDE words (the last ends with the text); attention
pools a window's states, and a logistic unit scores it. A document's score is its highest window's.

It is fitted here, to document labels, by multiple-instance learning: a toxic document's best window is
taken for toxic, a clean one's windows, the hardest among them, for clean. A fit sees a bounded sample of labelled rows
(TRAIN_DOCS of each class, in order of a hash of the id, of texts of at most TRAIN_CHARS characters) and takes a fixed
number of steps, so that its cost is bounded. A quarter of the sample is held out, and log odds are counted from the cut
that parts its classes best. Scoring covers whole texts of all rows.

Defined results: a null text or id isn't used to fit; a null text scores null and isn't toxic; a text
without words has no window and scores 0; without labels of both classes every text scores 0; of several labels of one id the
highest counts; a very long text is gone through in segments, with the very windows of the whole; repeated rows score alike; an empty table gives an empty one. Other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm._spark import free_name
from corpuskit.llm import _text
from corpuskit.llm._text import hash_words, mix, pieces, scan

WINDOW, STRIDE = 32, 16
TRAIN_DOCS, TRAIN_CHARS = {1: 1000, 0: 2000}, 20_000
STEPS, ROUNDS, BATCH = 900, 6, 128
WORDS, GRAMS = 1 << 14, 1 << 15
SIZE_WORD, SIZE_GRAM, HIDDEN, ATTEND = 8, 12, 8, 8

_GRAM = np.random.default_rng(13).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Features:
    """The distinct words of some texts: word and n-gram buckets, and for each text its words as indexes of these."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        data, starts, ends, self.offsets = scan(texts)
        hashes, first, self.words = np.unique(hash_words(data, starts), return_index=True, return_inverse=True)
        self.n = len(hashes)
        self.word_bucket = (hashes >> np.uint64(20)).astype(np.int64) & (WORDS - 1)
        starts, lengths = starts[first], (ends - starts)[first]
        total = lengths + 2
        begin = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(total, out=begin[1:])
        letters = np.full(begin[-1] + 8, ord("<"), dtype=np.uint8)
        within = np.arange(lengths.sum()) - np.repeat(begin[:-1] - 2 * np.arange(self.n), lengths)
        word = np.repeat(np.arange(self.n), lengths)
        letters[begin[word] + 1 + within] = data[starts[word] + within]
        letters[begin[1:] - 1] = ord(">")
        letters = letters.astype(np.uint64)
        self.grams = []
        for size in (3, 5):
            count = np.maximum(total - size + 1, 0)
            at = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(count, out=at[1:])
            where = np.arange(at[-1]) + np.repeat(begin[:-1] - at[:-1], count)
            value = sum(letters[where + j] * _GRAM[j] for j in range(size)) if len(where) else np.zeros(0, dtype=np.uint64)
            self.grams.append(((mix(value + np.uint64(size)) >> np.uint64(20)).astype(np.int64) & (GRAMS - 1), count, at))
        self.scale = (1 / np.sqrt(np.maximum(sum(c for _, c, _ in self.grams), 1))).astype(np.float32)

    def embed(self, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """The input vector of each distinct word."""
        out = np.zeros((self.n, word.shape[1] + gram.shape[1]), dtype=np.float32)
        out[:, : word.shape[1]] = word[self.word_bucket]
        for bucket, count, at in self.grams:
            some = count > 0
            if some.any():
                out[some, word.shape[1] :] += np.add.reduceat(gram[bucket], at[:-1][some], axis=0)
        out[:, word.shape[1] :] *= self.scale[:, None]
        return out


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window of the texts whose words start at the offsets."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + np.minimum(nth * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, start, np.minimum(n[text], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Parameters by name in self.p. Gates are ordered z, r, n; in each, forward before backward."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *s, by=1.0: (r.standard_normal(s) * by / np.sqrt(s[0])).astype(np.float32)
        size = SIZE_WORD + SIZE_GRAM
        self.p = {
            "word": np.zeros((WORDS, SIZE_WORD), dtype=np.float32),
            "gram": (r.standard_normal((GRAMS, SIZE_GRAM)) * 0.05).astype(np.float32),
            "inp": normal(size, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, dtype=np.float32),
            "fwd": normal(HIDDEN, 3 * HIDDEN), "bwd": normal(HIDDEN, 3 * HIDDEN),
            "att": normal(2 * HIDDEN, ATTEND), "att_v": normal(ATTEND), "out": normal(2 * HIDDEN), "out_b": np.full(1, -2, dtype=np.float32),
        }
        self.cut = 0.0

    def project(self, f: Features) -> np.ndarray:
        """What each distinct word adds to the gates; a last row for places without a word keeps the state as it is."""
        gates = f.embed(self.p["word"], self.p["gram"]) @ self.p["inp"] + self.p["bias"]
        rest = np.zeros((1, 6 * HIDDEN), dtype=np.float32)
        rest[:, : 2 * HIDDEN] = 40
        return np.concatenate([gates, rest])

    def scores(self, gates: np.ndarray, index: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Log odds of windows, given their words as rows of gates."""
        n, steps = index.shape
        h2, p = 2 * HIDDEN, self.p
        both = np.zeros((h2, 3 * h2), dtype=np.float32)
        for g in range(3):
            both[:HIDDEN, g * h2 : g * h2 + HIDDEN] = p["fwd"][:, g * HIDDEN : (g + 1) * HIDDEN]
            both[HIDDEN:, g * h2 + HIDDEN : (g + 1) * h2] = p["bwd"][:, g * HIDDEN : (g + 1) * HIDDEN]
        split = gates.reshape(-1, 3, 2, HIDDEN)
        fwd, bwd = np.ascontiguousarray(split[:, :, 0]), np.ascontiguousarray(split[:, :, 1])
        h = np.zeros((n, h2), dtype=np.float32)
        a = np.empty((n, 3, 2, HIDDEN), dtype=np.float32)
        states = np.empty((steps, n, h2), dtype=np.float32)
        for t in range(steps):
            a[:, :, 0], a[:, :, 1] = fwd[index[:, t]], bwd[index[:, steps - 1 - t]]
            x, q = a.reshape(n, 3 * h2), h @ both
            zr = _sigmoid(x[:, : 2 * h2] + q[:, : 2 * h2])
            new = np.tanh(x[:, 2 * h2 :] + zr[:, h2:] * q[:, 2 * h2 :])
            h = new + zr[:, :h2] * (h - new)
            states[t, :, :HIDDEN] = h[:, :HIDDEN]
            states[steps - 1 - t, :, HIDDEN:] = h[:, HIDDEN:]
        e = np.tanh(states @ p["att"]) @ p["att_v"]
        e[~valid.T] = -1e9
        e = np.exp(e - e.max(axis=0))
        return ((states @ p["out"]) * e).sum(axis=0) / e.sum(axis=0) + p["out_b"][0]

    def score_windows(self, f: Features, start: np.ndarray, words: np.ndarray, at_once: int = 2048) -> np.ndarray:
        gates = self.project(f)
        out = np.empty(len(start), dtype=np.float32)
        place = np.arange(WINDOW)
        for i in range(0, len(start), at_once):  # few windows at a time stay in the cache
            part = slice(i, i + at_once)
            valid = place < words[part, None]
            index = np.where(valid, f.words[np.minimum(start[part, None] + place, len(f.words) - 1)], f.n)
            out[part] = self.scores(gates, index, valid)
        return out

    def score_texts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text in 0..1, its number of windows)."""
        score, count = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for piece in pieces(texts):
            own = [texts[piece.start]] if len(texts[piece.start] or "") > _text.PIECE_CHARS else texts[piece]
            score[piece], count[piece] = self._score_long(own[0]) if len(own) == 1 else self._score_piece(own)
        return score, count

    def _score_long(self, text: str | None) -> tuple[float, int]:
        """The same windows as of the whole text, by its segments: each goes on from where the last window that it was sure of began."""
        best, count, carried = 0.0, 0, ""
        parts = _text.segments(text or "")
        part = next(parts)
        while True:
            following = next(parts, None)
            own = carried + part
            if following is None:
                score, n = self._score_piece([own])
                return max(best, float(score[0])), count + int(n[0])
            data, starts, _, offsets = scan([own])
            sure = max((len(starts) - WINDOW) // STRIDE, 0)
            if sure:
                begin = int(starts[sure * STRIDE])
                head = data[: int(starts[(sure - 1) * STRIDE + WINDOW])].tobytes().decode("utf-8", "replace")
                score, n = self._score_piece([head])
                best, count = max(best, float(score[0])), count + int(n[0])
                # What scan() has is in lower case already; a second time changes nothing.
                own = data[begin:-1].tobytes().decode("utf-8", "replace")
            carried, part = own, following

    def _score_piece(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        score, count = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        f = Features(texts)
        text, start, words = windows(f.offsets)
        if len(text):
            value = self.score_windows(f, start, words).astype(np.float64)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            score[text[first]] = 1 / (1 + np.exp(self.cut - np.maximum.reduceat(value, first)))
            count[text[first]] = np.diff(first, append=len(text))
        return score, count

    def gradients(self, f: Features, index: np.ndarray, valid: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """(loss, its gradient by each parameter) of windows of truth y."""
        p, (n, steps) = self.p, index.shape
        inputs = f.embed(p["word"], p["gram"])
        gates = np.concatenate([inputs @ p["inp"] + p["bias"], np.zeros((1, 6 * HIDDEN), dtype=np.float32)]).reshape(-1, 3, 2, HIDDEN)
        gates[-1, 0] = 40
        states = np.empty((n, steps, 2 * HIDDEN), dtype=np.float32)
        kept: list[list] = [[], []]
        for d, name in enumerate(("fwd", "bwd")):
            u, h = p[name], np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, q = gates[index[:, t], :, d], h @ u
                z, r = _sigmoid(x[:, 0] + q[:, :HIDDEN]), _sigmoid(x[:, 1] + q[:, HIDDEN : 2 * HIDDEN])
                q = q[:, 2 * HIDDEN :]
                new = np.tanh(x[:, 2] + r * q)
                kept[d].append((t, h, z, r, q, new))
                h = new + z * (h - new)
                states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        s = np.tanh(states @ p["att"])
        e = np.where(valid, s @ p["att_v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", alpha, states)
        logit = pooled @ p["out"] + p["out_b"][0]
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
        d_logit = (weight * (_sigmoid(logit) - y) / n).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_alpha = np.einsum("nth,nh->nt", states, d_pooled)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("nta,nt->a", s, d_e)
        d_s = d_e[:, :, None] * p["att_v"] * (1 - s * s)
        g["att"] = np.einsum("nth,nta->ha", states, d_s)
        d_states = alpha[:, :, None] * d_pooled[:, None] + d_s @ p["att"].T
        d_gates = np.zeros_like(gates)
        for d, name in enumerate(("fwd", "bwd")):
            u, d_u = p[name], np.zeros_like(p[name])
            d_h = np.zeros((n, HIDDEN), dtype=np.float32)
            for t, h, z, r, q, new in reversed(kept[d]):
                d_h = d_h + d_states[:, t, d * HIDDEN : (d + 1) * HIDDEN]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z, d_r = d_h * (h - new) * z * (1 - z), d_new * q * r * (1 - r)
                d_q = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ d_q
                d_h = d_h * z + d_q @ u.T
                np.add.at(d_gates[:, :, d], index[:, t], np.stack([d_z, d_r, d_new], axis=1))
            g[name] = d_u
        d_gates = d_gates[:-1].reshape(-1, 6 * HIDDEN)
        g["bias"], g["inp"] = d_gates.sum(axis=0), inputs.T @ d_gates
        d_inputs = d_gates @ p["inp"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], f.word_bucket, d_inputs[:, :SIZE_WORD])
        d_grams = d_inputs[:, SIZE_WORD:] * f.scale[:, None]
        for bucket, count, _ in f.grams:
            np.add.at(g["gram"], bucket, np.repeat(d_grams, count, axis=0))
        return loss, g


class _Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        by = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] * g[k] - self.v[k])
            x -= (by * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)


class _Part:
    """The distinct words that a batch of windows has, with the features of the whole."""

    def __init__(self, f: Features, index: np.ndarray) -> None:
        used, self.index = np.unique(index, return_inverse=True)
        self.index = self.index.reshape(index.shape)
        used = used[used < f.n]
        self.n, self.word_bucket, self.scale = len(used), f.word_bucket[used], f.scale[used]
        self.grams = []
        for bucket, count, at in f.grams:
            own = count[used]
            start = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(own, out=start[1:])
            self.grams.append((bucket[np.arange(start[-1]) + np.repeat(at[:-1][used] - start[:-1], own)], own, start))

    embed = Features.embed


def _seed_scores(f: Features, toxic: np.ndarray) -> np.ndarray:
    """Of each distinct word, the highest log odds of its 5-grams (of itself if it has none) between toxic and clean texts: which windows to begin with."""
    bucket, count, at = f.grams[1]

    def features(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in word, feature) of all features of some distinct words."""
        long = count[word] > 0
        own = np.where(long, count[word], 1)
        which = np.repeat(np.arange(len(word)), own)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
        gram = long[which]
        value = GRAMS + f.word_bucket[word[which]]
        value[gram] = bucket[at[word[which[gram]]] + nth[gram]]
        return which, value

    bad, good = np.zeros(GRAMS + WORDS), np.zeros(GRAMS + WORDS)
    for i, is_toxic in enumerate(toxic):  # text by text, as all together would take much room
        seen = np.unique(features(np.unique(f.words[f.offsets[i] : f.offsets[i + 1]]))[1])
        (bad if is_toxic else good)[seen] += 1
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    best = np.full(f.n, -np.inf)
    which, value = features(np.arange(f.n))
    np.maximum.at(best, which, odds[value])
    return best


def fit(texts: Sequence[str], toxic: Sequence[bool], seed: int = 1, steps: int = STEPS) -> Network | None:
    """A network for these labelled texts; None if they aren't of both classes."""
    truth = np.asarray(toxic, dtype=bool)
    if not truth.any() or truth.all():
        return None
    r = np.random.default_rng(seed)
    f = Features(texts)
    text, start, words = windows(f.offsets)
    place = np.arange(WINDOW)
    bad = truth[text]
    seed_of_word = np.append(_seed_scores(f, truth), -np.inf)
    value = np.empty(len(text))
    for i in range(0, len(text), 4096):
        part = slice(i, i + 4096)
        value[part] = seed_of_word[np.where(place < words[part, None], f.words[np.minimum(start[part, None] + place, len(f.words) - 1)], f.n)].max(axis=1)
    net = Network(seed)
    held = (np.cumsum(truth) * truth + np.cumsum(~truth) * ~truth) % 4 == 0
    fitted = ~held[text]
    adam = _Adam(net.p, 0.01)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    for round_ in range(ROUNDS):
        best = first + np.array([int(np.argmax(x)) for x in np.split(value, first[1:])], dtype=np.int64)
        positive = best[(bad & fitted)[best]]
        clean = np.flatnonzero(~bad & fitted)
        if not len(positive) or not len(clean):
            return None
        hard = clean[np.argsort(-value[clean], kind="stable")[: max(len(positive), 256)]]
        for step in range(steps // ROUNDS):
            pick = np.concatenate([r.choice(positive, BATCH // 4), r.choice(hard, BATCH // 4), r.choice(clean, BATCH // 2)])
            valid = place < words[pick, None]
            index = np.where(valid, f.words[np.minimum(start[pick, None] + place, len(f.words) - 1)], f.n)
            for row in range(BATCH - BATCH // 8, BATCH):  # clean words stay clean however often they are repeated
                run = r.integers(words[pick[row]])
                index[row, run : words[pick[row]]] = index[row, r.integers(words[pick[row]])]
            part = _Part(f, index)
            index = np.where(valid, part.index, part.n)
            _, g = net.gradients(part, index, valid, bad[pick].astype(np.float32), np.ones(BATCH, dtype=np.float32))
            adam.rate = 0.01 * (1 - 0.9 * (round_ * (steps // ROUNDS) + step) / steps)
            adam.step(g)
        value = net.score_windows(f, start, words).astype(np.float64)
    own = text[first]
    net.cut = best_cut(np.maximum.reduceat(value, first)[held[own]], truth[own][held[own]])
    return net


def best_cut(value: np.ndarray, truth: np.ndarray) -> float:
    """The value that parts the two classes with the least sum of their error rates, in the middle of the widest gap that does; 0 without both."""
    if not truth.any() or truth.all():
        return 0.0
    order = np.argsort(value, kind="stable")
    value, truth = value[order], truth[order]
    below = np.cumsum(truth)[:-1] / truth.sum()
    above = 1 - np.cumsum(~truth)[:-1] / (~truth).sum()
    gap = np.diff(value)
    cost = np.where(gap > 0, np.round(below + above, 9), np.inf)
    if not np.isfinite(cost).any():
        return 0.0
    i = max(np.flatnonzero(cost == cost.min()), key=lambda j: gap[j])
    return float(value[i] + gap[i] / 2)


def fit_to_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: dict[int, int] = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Network | None:
    """fit() to at most train_docs labelled documents, by class."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("boolean").cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= train_chars)
    order = F.xxhash64(F.col("id").cast("string"))
    # A few more labels than documents are wanted are drawn, as not all have a text here.
    drawn = [marks.where(F.col("y") == y).orderBy(order, "id").limit(4 * train_docs[y]) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    both = texts.join(chosen, "id").dropna(subset=["text"]).groupBy("id", "y").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(order, "id"))
    rows = both.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("y") == 1, train_docs[1]).otherwise(train_docs[0])).collect()
    rows.sort(key=lambda x: (x["y"], x["rank"]))
    return fit([x["text"] for x in rows], [x["y"] > 0 for x in rows])


def _score_udf(net: Network | None):
    @F.pandas_udf("struct<score: double, windows: bigint>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = texts.tolist()
            none = np.array([t is None for t in values], dtype=bool)
            s, n = net.score_texts(values) if net else (np.zeros(len(values)), np.zeros(len(values), dtype=np.int64))
            yield pd.DataFrame({"score": np.where(none, np.nan, s), "windows": n})

    return score


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_on: DataFrame | None, name: str) -> DataFrame:
    net = fit_to_labels(train_on if train_on is not None else docs, labels, id_col, text_col)
    made = _score_udf(net)(F.col(text_col))
    return docs.withColumn(name, made)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_on: DataFrame | None = None) -> DataFrame:
    """(id_col, score, windows, toxic) of each row of docs."""
    s = _scored(docs.select(id_col, text_col), labels, id_col, text_col, train_on, "s" if id_col != "s" else "s_")
    s = s.select(id_col, F.nanvl(s[s.columns[-1]]["score"], F.lit(None).cast("double")).alias("score"), s[s.columns[-1]]["windows"].alias("windows"))
    return s.withColumn("toxic", F.coalesce(F.col("score") >= 0.5, F.lit(False)))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_on: DataFrame | None = None) -> DataFrame:
    """docs without the toxic rows, their columns as they were."""
    name = free_name(docs, "scored")
    s = _scored(docs, labels, id_col, text_col, train_on, name)
    return s.where(~F.coalesce(F.nanvl(F.col(name)["score"], F.lit(0.0)) >= 0.5, F.lit(False))).drop(name)
