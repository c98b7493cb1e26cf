"""Operator 4, language identification: a bidirectional GRU over the bytes of each word.

A word's bytes are one sequence (words above ``PIECE`` bytes are several), so every position of a text gets its own
label probabilities, and equal words equal ones: a task runs the network once for each distinct word and remembers
a bounded number of them. A document's probabilities are pooled over all positions (mean log probability, then
normalised). Training is backpropagation through time in numpy, on a bounded sample of documents.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velado.llm.gru import Adam, glorot, gru_backward, gru_forward, gru_step
from velado.llm.learn import fold, one_row
from velado.llm.util import row_key, small_batches, text_rows
from velado.llm.words import Tile, byte_values, spans_hash, tile, tiles

PIECE, HIDDEN = 24, 20
#: Documents of each language to train on, and words taken from all of them for each language.
DOCS_PER_LANG, WORDS_PER_LANG = 400, 6000
REMEMBERED = 1 << 19
PARTS, HELD = 4, 2
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def pieces(t: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of all byte sequences: words with a letter or a byte above 127."""
    sums = np.concatenate([[0], np.cumsum(LETTER[t.data] | (t.data > 127))])
    doc = np.repeat(np.arange(len(t)), t.n_words)
    some = sums[t.end] > sums[t.start]
    start, end, doc = t.start[some], t.end[some], doc[some]
    n = (end - start + PIECE - 1) // PIECE
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(start, n) + nth * PIECE
    return begin, np.minimum(np.repeat(end, n) - begin, PIECE), np.repeat(doc, n)


class ByteGru:
    """Weights by name: input gates of each byte, recurrent weights, and the labels of both directions."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs, self.w = langs, weights

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteGru:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w |= {f"x{d}": glorot(rng, 256, 3 * hidden) * 3, f"u{d}": glorot(rng, hidden, 3 * hidden), f"o{d}": glorot(rng, hidden, len(langs))}
        return cls(langs, w | {"bias": np.zeros(len(langs), np.float32)})

    def log_probs(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 8192) -> np.ndarray:
        """Log probabilities of each sequence, summed over its positions."""
        out = np.zeros((len(start), len(self.langs)), np.float32)
        w = self.w
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            for part in (rows[i : i + block] for i in range(0, len(rows), block)):
                seq = data[start[part][:, None] + np.arange(size)]
                logits = np.empty((size, len(part), len(self.langs)), np.float32)
                for d, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
                    h = np.zeros((len(part), w[f"u{d}"].shape[0]), np.float32)
                    for t in order:
                        h = gru_step(w[f"x{d}"][seq[:, t]], h, w[f"u{d}"])
                        logits[t] = h @ w[f"o{d}"] + (w["bias"] if d == "f" else logits[t])
                logits -= logits.max(2, keepdims=True)
                out[part] = (logits - np.log(np.exp(logits).sum(2, keepdims=True))).sum(0)
        return out

    def train(self, seq: np.ndarray, length: np.ndarray, label: np.ndarray, epochs: int = 4, batch: int = 256, seed: int = 11) -> None:
        """Backpropagation through time; ``seq`` is (sequences, PIECE) bytes, every position has the label."""
        rng, adam, w = np.random.default_rng(seed), Adam(self.w, 0.01), self.w
        for epoch in range(epochs):
            adam.rate = 0.01 / (1 + epoch)
            order = rng.permutation(len(seq))
            for part in (order[i : i + batch] for i in range(0, len(order), batch)):
                n = length[part]
                top = int(n.max())
                mask = np.arange(top)[:, None] < n[None, :]
                s = seq[part][:, :top].T
                hf, kf = gru_forward(w["xf"][s], mask, w["uf"])
                hb, kb = gru_forward(w["xb"][s[::-1]], mask[::-1], w["ub"])
                hb = hb[::-1]
                logits = hf @ w["of"] + hb @ w["ob"] + w["bias"]
                p = np.exp(logits - logits.max(2, keepdims=True))
                p /= p.sum(2, keepdims=True)
                p[:, np.arange(len(part)), label[part]] -= 1
                d = (p * mask[:, :, None] / mask.sum()).astype(np.float32)
                k = w["uf"].shape[0]
                gf, uf = gru_backward(d @ w["of"].T, kf, w["uf"])
                gb, ub = gru_backward((d @ w["ob"].T)[::-1], kb, w["ub"])
                grads = {"uf": uf, "ub": ub, "bias": d.sum((0, 1))}
                grads["of"] = hf.reshape(-1, k).T @ d.reshape(-1, d.shape[2])
                grads["ob"] = np.ascontiguousarray(hb).reshape(-1, k).T @ d.reshape(-1, d.shape[2])
                for name, g, x in (("xf", gf, s), ("xb", gb, s[::-1])):
                    flat, at = g.reshape(-1, 3 * k), np.ascontiguousarray(x).reshape(-1)
                    hot = np.zeros((len(at), 256), np.float32)
                    hot[np.arange(len(at)), at] = 1
                    grads[name] = hot.T @ flat
                adam.step(grads)


class Remembered:
    """Results for each distinct word hash, by a sorted table that starts anew past a bound."""

    def __init__(self, model: ByteGru):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def __call__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        hashes = spans_hash(data, start, start + length, byte_values(5))
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.empty((len(keys), len(self.model.langs)), np.float32)
        out[known] = self.values[at[known]]
        new = first[~known]
        out[~known] = self.model.log_probs(data, start[new], length[new])
        if len(self.keys) > REMEMBERED:
            self.keys, self.values = keys, out
        else:
            merged = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.values = merged[order], np.concatenate([self.values, out[~known]])[order]
        return out[inverse]


def has_letter(t: Tile) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(LETTER[t.data])])
    out = sums[t.offsets[1:]] > sums[t.offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(t.offsets) > 0)):
        out[d] = any(c.isalpha() for c in t.text(d))
    return out


def predict(t: Tile, remembered: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language (-1: und) and its probability, for each document of the tile."""
    start, length, doc = pieces(t)
    k = len(remembered.model.langs)
    pooled, n = np.zeros((len(t), k)), np.bincount(doc, length, len(t))
    if len(start):
        lp = remembered(t.data, start, length)
        for c in range(k):
            pooled[:, c] = np.bincount(doc, lp[:, c], len(t)) / np.maximum(n, 1)
    p = np.exp(pooled - pooled.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = np.where(has_letter(t), p.argmax(1), -1)
    return best, np.where(best >= 0, p.max(1), 0.0)


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_lang: int = WORDS_PER_LANG) -> ByteGru | None:
    """Train on documents with a language outside the held-out fold; None if there are none.

    Bounded: ``docs_per_lang`` documents of each language, lowest hash of id and text first (repeated rows count
    once), and ``words_per_lang`` words drawn from their whole texts.
    """
    rows = text_rows(docs, "lang").where((fold(PARTS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    keyed = rows.withColumn("key", row_key())
    ids = keyed.select("key", "lang").distinct()
    picks = [ids.where(F.col("lang") == x).orderBy("key").limit(docs_per_lang) for x in langs]
    picked = picks[0]
    for x in picks[1:]:
        picked = picked.union(x)
    chosen = F.broadcast(picked)  # at most langs x docs_per_lang rows
    table = one_row(keyed.join(chosen, ["key", "lang"]).select("key", "lang", "text"), ["key", "lang"]).orderBy("key", "lang").toPandas()
    rng = np.random.default_rng(3)
    seqs, lengths, labels = [], [], []
    for i, lang in enumerate(langs):
        part = tile(pa.RecordBatch.from_pydict({"text": pa.array(table.text[table.lang == lang].tolist(), pa.string())}))
        start, length, _ = pieces(part)
        take = rng.permutation(len(start))[:words_per_lang]
        seq = np.zeros((len(take), PIECE), np.uint8)
        inside = np.arange(PIECE)[None, :] < length[take][:, None]
        seq[inside] = part.data[(start[take][:, None] + np.arange(PIECE))[inside]]
        seqs.append(seq)
        lengths.append(length[take])
        labels.append(np.full(len(take), i))
    model = ByteGru.new(langs)
    if sum(map(len, seqs)):
        model.train(np.concatenate(seqs), np.concatenate(lengths), np.concatenate(labels))
    return model


def identify(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``lang_pred`` and ``score`` of every row.

    ``und`` with score 0 for a null text or one without a letter, and for all rows if there is no model.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = Remembered(model) if model else None
        names = np.array([*(model.langs if model else []), "und"], object)
        for t in tiles(batches):
            best, score = predict(t, remembered) if model else (np.full(len(t), -1), np.zeros(len(t)))
            columns = [t.batch.column("row"), pa.array(names[best].tolist(), pa.string()), pa.array(score.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


#: A text whose best language has no majority of the pooled probability is in none of the learned languages.
MAJORITY = 0.5


def has_language(lang: str = "lang_pred", score: str = "score"):
    """Verdict on an identified row: it has letters, and one learned language holds the majority of its probability."""
    return (F.col(lang) != "und") & (F.col(score) >= MAJORITY)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document row. Repeated rows come back each, an empty table
    gives no rows, other columns are ignored; ``lang`` is read for training only."""
    found = identify(text_rows(docs), fit(docs)).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", (fold(PARTS) == HELD).alias("held_out"), "lang_pred", "score")
