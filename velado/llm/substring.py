"""Operator 1, substring dedup by De Bruijn compaction.

The edges are windows of ``window`` words; two places of the corpus lie on the same edge if their words are equal.
Every window names one node, its smallest ``seed``-word k-mer by hash (leftmost on a tie), so equal windows name
equal nodes. The run of consecutive windows with one node is a path through it, and is one row, not ``window`` rows:

1. A join of the rows on their node counts the paths through it. A node with one place is dropped. A path found at
   two places or more is a compacted, nonbranching repeat: all of its windows are repeated.
2. Where different paths meet at a node (it branches), the places are read again from their source coordinates,
   the paths are expanded into their edges, and the edges are joined. One place stands for each repeated path.
3. Windows found at two places or more cover words; the rest is kept.

Nodes, paths and edges are told apart by two 64-bit hashes together (node and path, or two of the edge). Places that
share a path are gathered in each task before the shuffle, so a passage in every third document is a few long rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velado.llm.util import stored, text_rows, wide_row_key
from velado.llm.words import Tile, spans_hash, tiles

WINDOW, SEED = 35, 11
#: One place of a path: the document row's key, the first word, and the words of the path.
PLACE = np.dtype([("key", "V16"), ("start", "<i4"), ("words", "<i4")])


def _keys(t: Tile) -> np.ndarray:
    """The rows' keys of 16 bytes."""
    return np.frombuffer(b"".join(t.batch.column("key").to_pylist()), "V16")


def paths(t: Tile, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one node: document, first word, end word (in the tile), node hash."""
    n = np.maximum(t.n_words - window + 1, 0)
    first = np.repeat(t.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    k = len(hashes) - seed + 1
    at = np.arange(k)
    node = spans_hash(hashes, at, at + seed)
    span, best, done = window - seed + 1, at, 1
    while done < span:
        step = min(done, span - done)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(node[right] < node[left], right, left)
        done += step
    named = best[first]
    doc = np.repeat(np.arange(len(t)), n)
    new = np.ones(len(first), bool)
    new[1:] = (named[1:] != named[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    last = np.concatenate([run[1:], [len(first)]]) - 1
    return doc[run], first[run], first[last] + window, node[named[run]]


def gathered(a: np.ndarray, b: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """``a, b, n, at``: places with equal (a, b) in one row."""
    order = np.lexsort((b, a))
    a, b, places = a[order], b[order], places[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    off = np.append(begin, len(a))
    at = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer((off * PLACE.itemsize).astype(np.int64)), pa.py_buffer(places.tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(a[begin].view(np.int64)), pa.array(b[begin].view(np.int64)), pa.array(np.diff(off).astype(np.int32)), at.cast(pa.binary())],
        ["a", "b", "n", "at"],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return text_rows(docs).withColumn("key", wide_row_key())


def path_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``a`` (node), ``b`` (path), ``n``, ``at`` (places) of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            words = t.word_hash()
            doc, start, end, node = paths(t, words, window, seed)
            if len(doc):
                places = np.empty(len(doc), PLACE)
                places["key"] = _keys(t)[doc]
                places["start"], places["words"] = start - t.first[doc], end - start
                yield gathered(node, spans_hash(words, start, end), places)

    return _keyed(docs).select("key", "text").mapInArrow(work, "a long, b long, n int, at binary")


def _binary(keys: np.ndarray) -> pa.Array:
    keys = np.ascontiguousarray(keys)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _places(rows: DataFrame) -> DataFrame:
    """The places of gathered rows, one row each, with the boolean columns ``whole`` and ``expand``. A whole path is
    expanded at its first place alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [np.frombuffer(x.as_py(), PLACE) for x in batch.column("at")]
            n = np.array([len(x) for x in raw])
            p = np.concatenate(raw)
            whole = np.repeat(batch.column("whole").to_numpy(zero_copy_only=False), n)
            expand = np.repeat(batch.column("expand").to_numpy(zero_copy_only=False), n)
            lead = np.zeros(len(p), bool)
            lead[np.cumsum(n) - n] = True
            yield pa.RecordBatch.from_arrays(
                [_binary(p["key"]), pa.array(p["start"]), pa.array(p["words"]), pa.array(whole), pa.array(expand & (lead | ~whole))],
                ["key", "start", "words", "whole", "expand"],
            )

    return rows.select("at", "whole", "expand").mapInArrow(work, "key binary, start int, words int, whole boolean, expand boolean")


def _by_key(places: DataFrame) -> DataFrame:
    """The spans of each key. Repeated rows share a key and have equal places: one of each stays, so an array is bounded
    by one document."""
    return places.select("key", "start", "words").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "words")).alias("spans"))


def _span_arrays(t: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, first words and lengths (in words) of the tile's ``spans`` column."""
    col = t.batch.column("spans")
    n = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    flat = col.flatten()
    doc = np.repeat(np.arange(len(t)), n)
    return doc, t.first[doc] + flat.field("start").to_numpy(), flat.field("words").to_numpy().astype(np.int64)


def edge_rows(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """``a, b`` (two hashes of an edge), ``n``, ``at`` of all windows of the given spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            doc, start, words = _span_arrays(t)
            n = words - window + 1
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            if len(at):
                places = np.empty(len(at), PLACE)
                places["key"] = _keys(t)[doc]
                places["start"], places["words"] = at - t.first[doc], window
                yield gathered(*(spans_hash(t.word_hash(s), at, at + window) for s in (1, 2)), places)

    rows = _keyed(docs).select("key", "text").join(spans, "key")
    return rows.mapInArrow(work, "a long, b long, n int, at binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``key, spans``: for each document row that has any, spans (first word, words) whose windows all repeat."""
    node, path = Window.partitionBy("a"), Window.partitionBy("a", "b")
    met = path_rows(docs, window, seed).select(
        "*", F.sum("n").over(path).alias("same"), F.row_number().over(path.orderBy("at")).alias("nth")
    ).select("*", F.sum("n").over(node).alias("through"))
    met = met.where("through > 1").select(
        "at", (F.col("same") > 1).alias("whole"), ((F.col("through") > F.col("same")) & ((F.col("same") == 1) | (F.col("nth") == 1))).alias("expand")
    )
    places = stored(_places(met).where("whole or expand"))
    edges = edge_rows(docs, _by_key(places.where("expand")), window)
    found = edges.select("at", F.sum("n").over(path).alias("same")).where("same > 1")
    found = _places(found.select("at", F.lit(True).alias("whole"), F.lit(False).alias("expand")))
    return _by_key(places.where("whole").select("key", "start", "words").union(found.select("key", "start", "words")))


def covered(t: Tile) -> np.ndarray:
    """Words of the tile that one of its spans covers."""
    _, start, words = _span_arrays(t)
    edge = np.zeros(len(t.start) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + words, -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document row, and the columns named in ``keep``.

    ``kept_text`` is the words that no repeated window covers, joined by one space (null text stays null). Windows
    lie in one document and are judged on the input; a repeated row counts as another place, so it loses its windows
    as well. Documents below ``window`` words lose nothing. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    rows = base.withColumn("key", wide_row_key()).join(repeated_spans(docs, window, seed), "key", "left").drop("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            gone = covered(t)
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[t.first[1:]] - sums[t.first[:-1]]
            null = t.batch.column("text").is_null().to_numpy(zero_copy_only=False)
            texts = []
            for d in range(len(t)):
                words = t.data[t.offsets[d] : t.offsets[d + 1]].tobytes().split()
                if removed[d]:
                    drop = gone[t.first[d] : t.first[d + 1]]
                    words = [w for w, x in zip(words, drop) if not x]
                texts.append(None if null[d] else b" ".join(words))
            out = t.batch.drop_columns(["text", "spans"])
            out = out.append_column("n_words", pa.array(t.n_words)).append_column("n_removed", pa.array(removed))
            yield out.append_column("kept_text", pa.array(texts, pa.binary()).cast(pa.string()))

    kept = [f for f in base.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    out = rows.mapInArrow(work, f"{schema}, n_words long, n_removed long, kept_text string")
    names = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *names)
