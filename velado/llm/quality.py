"""Operator 6, quality classifier: a sparse ensemble of rules over text statistics.

Statistics come from one pass over the words of every text. Small regression trees are boosted on a bounded sample of
labelled rows; every path from a root to a node is a rule, a conjunction of bounds on statistics. A lasso logistic
fit keeps few of them, and those are compiled into Spark column expressions, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velado.llm.gru import sigmoid
from velado.llm.hostrules import SYMBOLS, dup_lines, per_document, repeat_words
from velado.llm.learn import fold, sample_labels
from velado.llm.util import stored, text_rows
from velado.llm.words import SEP, Tile, tiles

PARTS, HELD, THRESHOLD = 4, 2, 0.7
#: Labelled documents of each class to train on.
PER_CLASS = 3000
STATS = (
    "n_words", "word_len", "long_words", "short_words", "upper", "upper_words", "digits", "symbols", "punct", "bang",
    "pipes", "high_bytes", "lines_per_word", "dup_lines", "repeat_words", "distinct_words", "top_word", "sentence_ends", "title_words",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
PUNCT, ENDS = _mask(b",;:-'\"()!?."), _mask(b".!?")


def statistics(t: Tile) -> np.ndarray:
    """One row of STATS for each document of the tile; all 0 for a text without words."""
    d = t.data
    lead = (d & 0xC0) != 0x80
    inside = lead & ~SEP[d]
    chars = per_document(inside, t.offsets)
    n = t.n_words
    size = np.diff(np.concatenate([[0], np.cumsum(inside)])[np.stack([t.start, t.end], 1)], axis=1)[:, 0] if len(t.start) else np.zeros(0)
    up = np.concatenate([[0], np.cumsum(UPPER[d])])
    low = np.concatenate([[0], np.cumsum(LOWER[d])])
    ups, lows = up[t.end] - up[t.start], low[t.end] - low[t.start]
    hashes = t.word_hash()
    words, max_share = np.zeros(len(t)), np.zeros(len(t))
    for i in range(len(t)):
        own = np.sort(hashes[t.first[i] : t.first[i + 1]])
        if len(own):
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            words[i], max_share[i] = len(edge) - 1, np.diff(edge).max()
    per_word = lambda x: x / np.maximum(n, 1)
    per_char = lambda x: per_document(x, t.offsets) / np.maximum(chars, 1)
    of_words = lambda x: per_word(per_document(x, t.first))
    return np.stack([
        np.log1p(n), chars / np.maximum(n, 1), of_words(size > 12), of_words(size <= 2), per_char(UPPER[d]),
        of_words((ups > 1) & (lows == 0)), per_char(DIGIT[d]), per_char(SYMBOLS[d]), per_char(PUNCT[d]), per_char(d == 33),
        per_word(per_document(d == 124, t.offsets)), per_char(d > 127), per_word(per_document(d == 10, t.offsets)),
        per_word(dup_lines(t)), per_word(repeat_words(t)), per_word(words), per_word(max_share), per_word(per_document(ENDS[d], t.offsets)),
        of_words(UPPER[d[t.start]] if len(t.start) else np.zeros(0, bool)),
    ], 1).astype(float)


@dataclass(frozen=True)
class Bound:
    stat: int
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.stat] > self.value) == self.above

    def column(self) -> Column:
        c = F.col(STATS[self.stat])
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)


Rule = tuple[Bound, ...]


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, stats: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """Gain, statistic and value of the split that fits gradients ``g`` (curvatures ``h``) best."""
    best = None
    for s in stats:
        order = np.argsort(x[:, s], kind="stable")
        v, cg, ch = x[order, s], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0]:
                best = (float(gain[k]), int(s), float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def tree_paths(x: np.ndarray, g: np.ndarray, h: np.ndarray, stats: np.ndarray, depth: int, least: int, path: Rule = ()) -> list[tuple[Rule, float, bool]]:
    """(path, fitted value, is a leaf) of all nodes below the root."""
    out = [(path, float(-g.sum() / (h.sum() + 1)), False)] if path else []
    split = best_split(x, g, h, stats, least) if depth and len(x) >= 2 * least else None
    if split is None or split[0] < 1e-6:
        return [(p, v, True) for p, v, _ in out]
    for above in (False, True):
        bound = Bound(split[1], above, split[2])
        rows = bound.holds(x)
        out += tree_paths(x[rows], g[rows], h[rows], stats, depth - 1, least, (*path, bound))
    return out


def _fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([b.holds(x) for b in rule])


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 4) -> list[Rule]:
    """Distinct paths of boosted trees, each grown on half of the rows and two thirds of the statistics."""
    rng = np.random.default_rng(seed)
    f, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = sigmoid(f)
        rows = rng.random(len(y)) < 0.5
        stats = rng.permutation(x.shape[1])[: -(-2 * x.shape[1] // 3)]
        for path, value, leaf in tree_paths(x[rows], (p - y)[rows], (p * (1 - p))[rows], stats, depth, max(5, len(y) // 400)):
            rules[tuple(sorted(path, key=lambda b: (b.stat, b.above, b.value)))] = None
            if leaf:
                f += rate * np.clip(value, -4, 4) * _fires(path, x)
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic fit with an L1 penalty on the weights (accelerated proximal steps)."""
    n = len(y)
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    rate = 4.0 * n / max(float((r.sum(1) + 1).sum()), 1.0)
    for _ in range(steps):
        e = sigmoid(r @ vw + vb) - y
        nw = vw - rate * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * e.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if (vw - nw) @ (nw - w) > 0:  # momentum points uphill: start it again
            t, t2 = 1.0, 1.0
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """The score as a column over STATS."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = rule[0].column()
            for b in rule[1:]:
                test = test & b.column()
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, penalty: float = 0.0015) -> RuleEnsemble:
    """Fit the ensemble; with one class only, it has no rule and scores the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    rules = boosted_rules(x, y)
    fires = np.stack([_fires(r, x) for r in rules], 1).astype(float)
    weights, intercept = lasso_logistic(fires, y.astype(float), penalty)
    return RuleEnsemble([(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6], intercept)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and STATS of every document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            x = statistics(t)
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), *(pa.array(x[:, i]) for i in range(len(STATS)))], ["doc_id", *STATS])

    rows = text_rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATS))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row.

    Trained on at most ``per_class`` labelled documents of each class outside the held-out fold; a repeated id counts
    once, by its row of the lowest statistics. Null and empty texts have statistics 0 and get a score as any other.
    Without labels all scores are 0.5. Repeated rows come back each; an empty table gives no rows; other columns are
    ignored.
    """
    stats = stored(document_statistics(docs))
    picked = sample_labels(labels, "quality", PARTS, HELD, per_class)
    rows = stats.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*STATS)).alias("least"))
    table = rows.select("doc_id", "label", "least.*").orderBy("doc_id").toPandas()  # at most 2 x per_class rows
    model = learn(table[list(STATS)].to_numpy(float), table["label"].to_numpy())
    scored = stats.select("doc_id", (fold(PARTS) == HELD).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
