"""Operator 8, toxicity: a bidirectional GRU with attention pooling over overlapping word windows.

A word enters as a hashed word vector and the mean of its hashed character n-gram vectors (lower case, with marks at both
ends). Windows of ``WINDOW`` words, every ``STRIDE`` words, cover the whole text; attention weights pool a
window's states into one logit, and a document's score is that of its most toxic window. Training, in numpy by
backpropagation through time, knows only document labels: each document of a bounded sample is learned from the
window that scores highest so far. The vectors start from the sample's smoothed log odds.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velado.llm.gru import Adam, glorot, gru_backward, gru_forward, gru_step, sigmoid
from velado.llm.learn import fold, one_row, sample_labels
from velado.llm.util import small_batches, stored, text_rows
from velado.llm.words import LOWER, Tile, byte_values, mix, spans_hash, tile, tiles

WINDOW, STRIDE, HIDDEN = 48, 32, 12
GRAMS = (3, 4, 5)
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM = 1 << 15, 1 << 16, 3, 8
PARTS, HELD, THRESHOLD, ROUNDS = 3, 1, 0.7, 3
#: Labelled documents of each class to train on.
PER_CLASS = 1600
#: A word or n-gram that fewer documents of the sample have is not told from an unknown one: it has no vector, so no
#: document can be learned by heart from it.
LEAST_DOCUMENTS = 24


def distinct_words(t: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their n-gram buckets with the owning word (flat), n-gram counts, and each word's number."""
    low = LOWER[t.data]
    keys, first, inverse = np.unique(t.word_hash(1, low), return_index=True, return_inverse=True)
    size = (t.end - t.start)[first] + 2
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size)  # 0 and size - 1 are the marks
    source = np.repeat(t.start[first], size) + at - 1
    chars = low[np.clip(source, 0, max(len(low) - 1, 0))].copy()
    chars[off[:-1]], chars[off[1:] - 1] = 1, 2
    owners, grams = [], []
    for g in GRAMS:
        begin = np.flatnonzero(at + g <= np.repeat(size, size))
        owners.append(np.repeat(np.arange(len(first), dtype=np.int32), size)[begin])
        grams.append((spans_hash(chars, begin, begin + g, byte_values(4)) % np.uint64(GRAM_BUCKETS)).astype(np.int32))
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    n = np.bincount(owner, minlength=len(first))
    return (keys % np.uint64(WORD_BUCKETS)).astype(np.int64), gram[order], owner[order], n, inverse


def windows(t: Tile, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of all windows; the last one ends with the text, a short text is one."""
    n = t.n_words
    count = np.where(n > size, -(-np.maximum(n - size, 0) // stride) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(t)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(nth * stride, np.maximum(n[doc] - size, 0))
    return t.first[doc] + at, np.minimum(n[doc], size), doc


class AttentionGru:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.known: np.ndarray | None = None  # word and n-gram buckets that have a vector; None: all

    @classmethod
    def new(cls, hidden: int = HIDDEN, seed: int = 5) -> AttentionGru:
        rng, dim = np.random.default_rng(seed), WORD_DIM + GRAM_DIM
        w = {"word": glorot(rng, WORD_BUCKETS, WORD_DIM), "gram": glorot(rng, GRAM_BUCKETS, GRAM_DIM)}
        for d in "fb":
            w |= {f"x{d}": glorot(rng, dim, 3 * hidden), f"u{d}": glorot(rng, hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}
        w |= {"att": glorot(rng, 2 * hidden, hidden), "v": glorot(rng, hidden, 1)[:, 0], "out": glorot(rng, 2 * hidden, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        return cls(w)

    def inputs(self, word: np.ndarray, grams: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        mean = np.stack([np.bincount(owner, self.w["gram"][grams, j], len(n)) for j in range(GRAM_DIM)], 1) / np.maximum(n, 1)[:, None]
        return np.concatenate([self.w["word"][word], mean], 1).astype(np.float32)

    def logits(self, x: np.ndarray, number: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 4096) -> np.ndarray:
        """Logit of each window; ``x`` has the distinct words' vectors, ``number`` which of them each word is."""
        w, out = self.w, np.zeros(len(start), np.float32)
        gates = {d: x @ w[f"x{d}"] + w[f"c{d}"] for d in "fb"}
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            for part in (rows[i : i + block] for i in range(0, len(rows), block)):
                seq = number[(start[part][:, None] + np.arange(size)).T]
                k = w["uf"].shape[0]
                states = np.empty((size, len(part), 2 * k), np.float32)
                for d, order, to in (("f", range(size), slice(0, k)), ("b", range(size - 1, -1, -1), slice(k, 2 * k))):
                    h = np.zeros((len(part), k), np.float32)
                    for t in order:
                        states[t, :, to] = h = gru_step(gates[d][seq[t]], h, w[f"u{d}"])
                e = np.tanh(states @ w["att"]) @ w["v"]
                a = np.exp(e - e.max(0))
                out[part] = (a * (states @ w["out"])).sum(0) / a.sum(0) + w["bias"][0]
        return out

    def backprop(self, t: dict, start: np.ndarray, length: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over the windows; ``t`` has the tile's distinct words."""
        w, top = self.w, int(length.max())
        k = w["uf"].shape[0]
        mask = np.arange(top)[:, None] < length[None, :]
        seq = t["number"][np.minimum(start[None, :] + np.arange(top)[:, None], len(t["number"]) - 1)]
        used, where = np.unique(seq, return_inverse=True)
        where = where.reshape(seq.shape)
        x = t["x"][used]
        if t.get("blind"):  # half of the words are known by their characters alone
            x = x.copy()
            x[np.random.default_rng(int(start[0])).random(len(x)) < 0.5, :WORD_DIM] = 0
        vec = x[where]
        hf, kf = gru_forward(vec @ w["xf"] + w["cf"], mask, w["uf"])
        hb, kb = gru_forward((vec @ w["xb"] + w["cb"])[::-1], mask[::-1], w["ub"])
        s = np.concatenate([hf, hb[::-1]], 2)
        q = np.tanh(s @ w["att"])
        e = np.where(mask, q @ w["v"], -1e9)
        a = np.exp(e - e.max(0)) * mask
        a /= a.sum(0)
        o = s @ w["out"]
        p = sigmoid((a * o).sum(0) + w["bias"][0])
        d = ((p - label) / len(label)).astype(np.float32)
        do = (a * d).astype(np.float32)
        de = a * d * (o - (a * o).sum(0))
        dq = (de[:, :, None] * w["v"] * (1 - q * q)).astype(np.float32)
        ds = do[:, :, None] * w["out"] + dq @ w["att"].T
        flat = s.reshape(-1, 2 * k)
        g = {"out": flat.T @ do.reshape(-1), "bias": d.sum(keepdims=True), "v": q.reshape(-1, k).T @ de.reshape(-1).astype(np.float32)}
        g["att"] = flat.T @ dq.reshape(-1, k)
        gf, g["uf"] = gru_backward(ds[:, :, :k], kf, w["uf"])
        gb, g["ub"] = gru_backward(ds[::-1, :, k:], kb, w["ub"])
        gb = gb[::-1]
        dvec = gf @ w["xf"].T + gb @ w["xb"].T
        v2 = vec.reshape(-1, vec.shape[2])
        for n, gg in (("f", gf), ("b", gb)):
            g[f"x{n}"], g[f"c{n}"] = v2.T @ gg.reshape(-1, 3 * k), gg.sum((0, 1))
        dx = np.zeros_like(x)
        np.add.at(dx, where.reshape(-1), dvec.reshape(-1, dvec.shape[2]))
        g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        np.add.at(g["word"], t["word"][used], dx[:, :WORD_DIM])
        begin = np.concatenate([[0], np.cumsum(t["n"])])
        at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in used])
        np.add.at(g["gram"], t["grams"][at], np.repeat(dx[:, WORD_DIM:] / t["n"][used][:, None], t["n"][used], axis=0))
        if self.known is not None:
            g["word"][~self.known[:WORD_BUCKETS]] = 0
            g["gram"][~self.known[WORD_BUCKETS:]] = 0
        return g

    def start_from_log_odds(self, seen: np.ndarray, total: np.ndarray) -> None:
        """Set the first number of each word and n-gram vector to its smoothed log odds of a toxic document, from
        ``document_counts`` and the number of clean and toxic documents."""
        clean, toxic = seen
        odds = np.log((toxic + 0.3) / (total[1] + 1)) - np.log((clean + 0.3) / (total[0] + 1))
        self.known = clean + toxic >= min(LEAST_DOCUMENTS, 1 + total.sum() // 20)
        odds = np.clip(odds, -2, 6) * self.known
        self.w["word"][:, 0], self.w["gram"][:, 0] = odds[:WORD_BUCKETS], odds[WORD_BUCKETS:]
        self.w["word"][~self.known[:WORD_BUCKETS]] = 0
        self.w["gram"][~self.known[WORD_BUCKETS:]] = 0

    def best_and_clean(self, t: Tile, label: np.ndarray, key: np.ndarray, turn: int, most: int) -> tuple[np.ndarray, ...]:
        """Windows of a tile to learn from: the highest of each document, and as another window of the clean documents,
        which are clean throughout, at most ``most`` in the order of a hash. First word, length, document, place in
        the order (the highest windows come first, with a flag)."""
        start, length, doc = windows(t)
        word, grams, owner, n, number = distinct_words(t)
        x = self.inputs(word, grams, owner, n)
        if turn:
            rank = self.logits(x, number, start, length)
        else:
            # A window's first rank: its two strongest words, by the log odds they start from.
            own = x[:, 0] + x[:, WORD_DIM] * 2
            rank = np.array([np.sort(own[number[a : a + m]])[-2:].sum() for a, m in zip(start, length)])
        best = np.lexsort((-rank, doc))
        best = best[np.concatenate([[True], doc[best][1:] != doc[best][:-1]])]
        order = mix(mix(key.astype(np.int64).view(np.uint64))[doc] + (start - t.first[doc]).astype(np.uint64) * np.uint64(2 * ROUNDS) + np.uint64(turn)).view(np.int64)
        other = np.flatnonzero(label[doc] == 0)
        other = other[np.argsort(order[other], kind="stable")][:most]
        rows = np.concatenate([best, other])
        return start[rows], length[rows], doc[rows], order[rows], np.arange(len(rows)) >= len(best)

    def learn(self, t: Tile, label: np.ndarray, adam: Adam, rng: np.random.Generator, epochs: int = 2, batch: int = 64) -> None:
        """Backpropagation over the tile's documents, each of one window."""
        word, grams, owner, n, number = distinct_words(t)
        have = {"word": word, "grams": grams, "n": n, "number": number, "blind": True}
        have["x"] = self.inputs(word, grams, owner, n)
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for part in (order[i : i + batch] for i in range(0, len(order), batch)):
                adam.step(self.backprop(have, t.first[part], t.n_words[part], label[part].astype(np.float32)))
            have["x"] = self.inputs(word, grams, owner, n)

    def to_rate(self, share: float, rate: float) -> None:
        """Move the bias from the toxic share of the windows trained on to the rate of toxic documents."""
        if 0 < share < 1:
            rate = min(max(rate, 1e-3), 0.999)
            self.w["bias"] += np.float32(np.log(rate / (1 - rate)) - np.log(share / (1 - share)))

    def score(self, t: Tile) -> np.ndarray:
        """Score of each document: its highest window (0 for a text without words)."""
        out = np.full(len(t), -np.inf)
        start, length, doc = windows(t)
        if len(start):
            word, grams, owner, n, number = distinct_words(t)
            np.maximum.at(out, doc, self.logits(self.inputs(word, grams, owner, n), number, start, length))
        return np.where(np.isinf(out), 0.0, sigmoid(out))


def document_counts(t: Tile, label: np.ndarray, block: int = 64) -> np.ndarray:
    """Clean and toxic documents of the tile that have each word bucket, then each n-gram bucket; a few documents at a
    time are counted."""
    word, grams, _, count, number = distinct_words(t)
    begin = np.concatenate([[0], np.cumsum(count)])
    seen = np.zeros((2, WORD_BUCKETS + GRAM_BUCKETS), np.int64)
    for d in range(0, len(label), block):
        last = min(d + block, len(label))
        doc = np.repeat(np.arange(last - d), np.diff(t.first[d : last + 1]))
        pair = np.unique(doc * len(count) + number[t.first[d] : t.first[last]])
        doc, own = pair // max(len(count), 1), pair % max(len(count), 1)
        n = count[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for low, buckets, owner, of in ((0, WORD_BUCKETS, doc, word[own]), (WORD_BUCKETS, GRAM_BUCKETS, np.repeat(doc, n), grams[at])):
            once = np.unique(owner * buckets + of)
            for y in (0, 1):
                seen[y, low : low + buckets] += np.bincount((once % buckets)[label[d + once // buckets] == y], minlength=buckets)
    return seen


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tile, np.ndarray]]:
    """Tiles that have words, and their documents' labels."""
    for t in tiles(batches):
        if t.n_words.any():
            yield t, t.batch.column("label").to_numpy()


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``document_counts`` of all rows, and the clean and toxic rows that have words. The driver gets one row a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, label in _labelled(batches):
            seen = np.concatenate([document_counts(t, label), [[(t.n_words[label == y] > 0).sum()] for y in (0, 1)]], 1)
            at = np.flatnonzero(seen.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["at", "clean", "toxic"])

    got = rows.mapInArrow(work, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, WORD_BUCKETS + GRAM_BUCKETS + 1), np.int64)
    seen[:, got["at"].to_numpy()] = [got["clean"].to_numpy(), got["toxic"].to_numpy()]
    return seen[:, :-1], seen[:, -1]


def _chosen(rows: DataFrame, model: AttentionGru, turn: int, n: int) -> tuple[Tile, np.ndarray]:
    """The windows to learn from in this round, as a tile, and their labels: the highest window of each of the ``n``
    documents, and 2 x ``n`` windows of the clean ones. Only these come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, label in _labelled(batches):
            start, length, doc, order, other = model.best_and_clean(t, label, t.batch.column("key").to_numpy(), turn, 2 * n)
            texts = [b" ".join(t.data[t.start[a] : t.end[a + m - 1]].tobytes().split()) for a, m in zip(start, length)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(other), pa.array(order), pa.array(label[doc].astype(np.int32)), pa.array(texts, pa.binary())], ["other", "place", "label", "words"]
            )

    found = rows.mapInArrow(work, "other boolean, place long, label int, words binary")
    got = found.orderBy("other", "place", "words").limit(3 * n).toArrow()
    texts = got["words"].combine_chunks().cast(pa.large_binary()).view(pa.large_string())
    return tile(pa.RecordBatch.from_arrays([texts], ["text"])), got["label"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 9) -> AttentionGru | None:
    """Train on at most ``per_class`` labelled documents of each class outside the held-out fold, by whole texts.
    A repeated id counts once (the text with the lowest hash).

    The texts stay in tasks, which count words and rank windows. The driver gets one row a bucket, and in each round
    three windows a document, so its memory does not grow with the documents' length. None if either class is missing:
    every score is then 0.
    """
    picked = sample_labels(labels, "toxic", PARTS, HELD, per_class)
    rows = one_row(text_rows(docs).join(F.broadcast(picked), "doc_id"), ["doc_id"])  # at most 2 x per_class rows
    rows = stored(rows.select("text", "label", F.xxhash64("doc_id", "text").alias("key")))
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    model = AttentionGru.new()
    seen, total = _counted(rows)
    if not total.any():
        return model
    model.start_from_log_odds(seen, total)
    rng, adam = np.random.default_rng(seed), Adam(model.w, 0.01)
    for turn in range(ROUNDS):
        t, label = _chosen(rows, model, turn, int(total.sum()))
        model.learn(t, label, adam, rng)
        adam.rate *= 0.5
    rate = labels.where(fold(PARTS) != HELD).agg(F.avg("toxic")).first()[0]
    model.to_rate(float(label.mean()), float(rate))
    return model


def score_rows(docs: DataFrame, model: AttentionGru | None) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and ``score`` of every row; null, empty and wordless texts
    score 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            score = model.score(t) if model else np.zeros(len(t))
            yield pa.RecordBatch.from_arrays([t.batch.column("row"), pa.array(score.astype(float))], ["row", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row. Repeated rows come back each; an empty table
    gives no rows; other columns are ignored."""
    scored = score_rows(text_rows(docs), fit(docs, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", (fold(PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
