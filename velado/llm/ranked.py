"""Operator 11, ranked lexical search: term-at-a-time scores with limited accumulators.

The documents are read once: every one becomes a row of its terms' numbers and occurrences, restricted to the
queries' terms, plus its length. Corpus counts come from those rows by pre-aggregated sums. The rows are then dealt
evenly over tasks, which cut them into blocks of bounded postings. In a block the lists of a query are walked rarest
first. Once what the remaining lists can add to a document stays below the k-th partial score (never less than the
k-th score of the task's earlier blocks), no new accumulator is made, and the lists that remain only update the
survivors, by probing when those are few. Scores are sums of integers, so the result equals the full evaluation.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velado.llm.util import stored, text_rows
from velado.llm.words import LOWER, Tile, spans_hash, byte_values, tiles

K = 20
#: Postings of a block, so that its lists stay within some 100 MB.
BLOCK_POSTINGS = 1 << 22
#: Text bytes of the queries that are asked in one pass over the documents.
QUERY_BYTES = 8 << 20
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_hashes(t: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every term, lower-cased: together they stand for its bytes."""
    low = LOWER[t.data]
    return t.word_hash(11, low), spans_hash(low, t.start, t.end, byte_values(12))


class Queries:
    """A block of queries: their vocabulary, sorted by hash, and each query's term numbers with repeats."""

    def __init__(self, texts: list[str | None]):
        t = next(iter(tiles(iter([pa.record_batch([pa.array(texts, pa.string())], ["text"])]), limit=1 << 62, sep=NOT_TERM)))
        first, second = term_hashes(t)
        self.first, at, number = np.unique(first, return_index=True, return_inverse=True)
        self.second = second[at]
        self.terms = [np.unique(number[a:b], return_counts=True) for a, b in zip(t.first[:-1], t.first[1:])]

    def numbers(self, t: Tile) -> np.ndarray:
        """The vocabulary number of every term of the tile, or -1."""
        first, second = term_hashes(t)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)


def _postings(queries: Queries):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches, sep=NOT_TERM):
            n, size = t.n_words, max(len(queries.first), 1)
            number = queries.numbers(t) if len(queries.first) else np.full(len(t.start), -1)
            doc = np.repeat(np.arange(len(t)), n)[number >= 0]
            pair, tf = np.unique(doc * size + number[number >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(len(t) + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pair % size, tf)]
            keep = np.flatnonzero(n)
            out = pa.RecordBatch.from_arrays([t.batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.take(pa.array(keep))

    return work


class Block:
    """Inverted lists of a block of documents, with every posting's share of a score before the term's weight."""

    def __init__(self, doc_id: np.ndarray, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, length: int, size: int):
        self.doc_id = doc_id
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        m = 75 + (25 * n * total) // length
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        self.first = np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.array([self.part[a:b].max(initial=0) for a, b in zip(self.first[:-1], self.first[1:])], np.int64)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) and scores of all that can be among the k best and reach ``floor``.

        ``terms`` come rarest first, with their ``weight`` times their repeats in the query.
        """
        score = np.zeros(len(self.doc_id), np.int64)
        live = np.zeros(0, np.int64)
        left = np.cumsum((weight * self.most[terms])[::-1])[::-1]
        growing = True
        for i, (t, w) in enumerate(zip(terms, weight)):
            a, b = self.first[t], self.first[t + 1]
            if growing and left[i] < max(floor, self._kth(score, live, k, left[i])):
                growing = False
            if a == b or w == 0:
                continue
            doc, part = self.doc[a:b], self.part[a:b]
            if growing:
                new = doc[(score[doc] == 0) & (part > 0)]
                score[doc] += w * part
                live = np.concatenate([live, new])
            elif len(live) * 8 < b - a:
                at = np.minimum(np.searchsorted(doc, live), b - a - 1)
                hit = doc[at] == live
                score[live[hit]] += w * part[at[hit]]
            else:
                hit = score[doc] > 0
                score[doc[hit]] += w * part[hit]
        live = live[score[live] >= max(floor, self._kth(score, live, k, 0), 1)]
        return live, score[live]

    @staticmethod
    def _kth(score: np.ndarray, live: np.ndarray, k: int, least: int) -> int:
        """The k-th best partial score, if it can exceed ``least``; else 0."""
        have = score[live]
        return int(np.partition(have, -k)[-k]) if len(have) >= k and have.max() > least else 0


def _search(queries: Queries, weight: np.ndarray, df: np.ndarray, total: int, length: int, k: int, limit: int):
    asked = []
    for number, times in queries.terms:
        order = np.lexsort((number, df[number]))
        asked.append((number[order], weight[number[order]] * times[order]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, postings = [], 0
        for batch in batches:
            at = 0
            ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, before + limit - postings, "right")), at if held else at + 1)
                held.append(batch.slice(at, to - at))
                postings += (int(ends[to - 1]) if to else 0) - before
                at = to
                if at < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, postings = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in asked]
        for table in blocks(batches):
            table = table.combine_chunks()
            parts = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (table.column(x) for x in ("terms", "tfs"))]
            if not table.num_rows:
                continue
            off = parts[0].offsets.to_numpy()
            flat = [p.values.to_numpy()[off[0] : off[-1]].astype(np.int64) for p in parts]
            ids = table.column("doc_id")
            none = ids.is_null().to_numpy()
            block = Block(ids.fill_null(0).to_numpy(), table.column("n").to_numpy(), off - off[0], *flat, total, length, len(queries.first))
            for q, (terms, w) in enumerate(asked):
                if len(terms):
                    score, doc, null = best[q]
                    found, s = block.search(terms, w, k, int(score[-1]) if len(score) >= k else 0)
                    score, doc, null = np.concatenate([score, s]), np.concatenate([doc, block.doc_id[found]]), np.concatenate([null, none[found]])
                    top = np.lexsort((doc, null, -score))[:k]
                    best[q] = (score[top], doc[top], null[top])
        number = np.concatenate([np.full(len(b[0]), q) for q, b in enumerate(best)]) if best else np.zeros(0, np.int64)
        score, doc, null = (np.concatenate([b[i] for b in best]) if best else np.zeros(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["query", "doc_id", "score"]
        )

    return work


def _top(found: DataFrame, k: int, *more: str) -> DataFrame:
    w = Window.partitionBy("query", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ask(docs: DataFrame, items: list, k: int, block_postings: int) -> DataFrame:
    queries = Queries([r.text for r in items])
    rows = text_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = rows.mapInArrow(_postings(queries), "doc_id long, n long, terms array<int>, tfs array<int>")
    index = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    total, length, postings = (x or 0 for x in index.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first())
    df = np.zeros(max(len(queries.first), 1), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a query term at most
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    parts = max(1, -(-postings // block_postings))
    spread = index.where(F.size("terms") > 0).repartition(parts, F.xxhash64("uid")).drop("uid")
    found = spread.mapInArrow(_search(queries, weight, df, total, length, k, block_postings), "query long, doc_id long, score long")
    # Two steps, so that the best of many tasks never meet in one.
    salted = found.withColumn("salt", F.spark_partition_id() % max(1, math.isqrt(parts)))
    best = _top(_top(stored(salted), k, "salt").drop("rank", "salt"), k)
    names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "query long, item_id long")
    return best.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_postings: int = BLOCK_POSTINGS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every row of ``items`` (``item_id``, ``text``).

    Only documents with a score above 0 return, so an item may have fewer than k, or none (null, empty or unknown
    text). Ties go to the smaller doc_id (null ids last). Null texts hold no term; a repeated document or item is one
    more of its own; empty tables give no rows; other columns are ignored. The items are asked in groups of about
    ``query_bytes`` of text, each in one pass over the documents; one longer item is a group of its own.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + size // query_bytes
    out = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        if rows:
            part = _ask(docs, rows, k, block_postings)
            out = part if out is None else out.unionByName(stored(part))
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
