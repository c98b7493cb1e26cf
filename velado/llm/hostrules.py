"""Operator 10, quality rules: rule failures of documents, shrunk to host verdicts.

Every document gets counts and a base verdict from one pass over its words. Failures are then summed by host
(``source``), a beta prior is fitted to the hosts' rates by moments, and a host is rejected when most of its documents
fail for sure: when the lower bound of its shrunk rate (``Z`` posterior deviations below it) is above one half. Host verdicts go back to the documents by a join on the host; those of hosts above ``HOST_ROWS`` documents are
broadcast, so a host that holds a third of all rows is no task of its own.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velado.llm.util import small_side, stored, text_rows
from velado.llm.words import SEP, Tile, tiles

#: Documents of a host up to which its rows meet in one task, and the one-sided 95 % bound in posterior deviations.
HOST_ROWS, Z = 100_000, 1.645
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``flags[offsets[d]:offsets[d+1]]`` are set, for each d."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeat_words(t: Tile, k: int = 5) -> np.ndarray:
    """Words of each document that lie in a window of k words found twice or more in it."""
    at, h = t.windows(t.word_hash(), k)
    doc = np.searchsorted(t.first, at, "right") - 1
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(t.start) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return per_document(np.cumsum(edge)[:-1] > 0, t.first)


def dup_lines(t: Tile) -> np.ndarray:
    out = np.zeros(len(t), np.int64)
    breaks = np.flatnonzero(t.data == 10)
    for d in np.flatnonzero(np.diff(np.searchsorted(breaks, t.offsets))):
        lines = [x for x in t.data[t.offsets[d] : t.offsets[d + 1]].tobytes().split(b"\n") if x.split()]
        out[d] = len(lines) - len(set(lines))
    return out


def counts(t: Tile) -> dict[str, np.ndarray]:
    lead = (t.data & 0xC0) != 0x80
    return {
        "n_words": t.n_words,
        "word_chars": per_document(lead & ~SEP[t.data], t.offsets),
        "n_symbols": per_document(SYMBOLS[t.data], t.offsets),
        "n_dup_lines": dup_lines(t),
        "n_repeat_words": repeat_words(t),
    }


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the five counts of every document row (null text: zeros)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            got = counts(t)
            yield pa.RecordBatch.from_arrays(
                [t.batch.column("doc_id"), t.batch.column("source"), *(pa.array(got[c].astype(np.int64)) for c in _COUNTS)],
                ["doc_id", "source", *_COUNTS],
            )

    rows = text_rows(docs, F.col("source").cast("string").alias("source"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters whose mean and spread match the hosts' failure rates (method of moments).

    The spread between hosts is the variance of their rates less what the counts alone would give. Without hosts,
    or without such spread, the prior weighs 1,000 documents at the mean rate (0.5 if there are none).
    """
    rate = F.col("failed") / F.col("n")
    r = hosts.agg(
        F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("inv"), F.count("*").alias("k")
    ).first()
    m = min(max(r.m if r.m is not None else 0.5, 1e-4), 1 - 1e-4)
    spread = (r.v or 0.0) - m * (1 - m) * (r.inv or 0.0)
    weight = min(max(m * (1 - m) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
    return m * weight, (1 - m) * weight


def host_rules(docs: DataFrame, majority: float = 0.5, z: float = Z) -> DataFrame:
    """Counts, ``base_failed``, ``host_rate``, ``host_low`` and ``kept`` of every document row.

    A document fails by itself with fewer than 10 words or with more than 20 % repeated words. ``kept`` is false then,
    or when its host is rejected: its shrunk failure rate less ``z`` posterior deviations is above ``majority``, so
    that a host of few documents needs more than a few failures. Null hosts are one host of their own; null texts have
    no words; repeated rows count and come back each; an empty table gives no rows; other columns are ignored.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stored(document_counts(docs).withColumn("base_failed", failed))
    host = F.coalesce(F.concat(F.lit("h:"), "source"), F.lit("none")).alias("host")
    hosts = rows.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("int")).alias("failed"))
    hosts = stored(hosts)
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    low = F.col("host_rate") - z * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + a + b + 1))
    verdicts = hosts.withColumn("host_rate", rate).withColumn("host_low", low)
    # Hosts of many documents are few (at most one for HOST_ROWS rows), so their verdicts are broadcast; the rows of any
    # other host are few enough to meet in one task.
    large = small_side(verdicts.where(F.col("n") > HOST_ROWS))
    marked = rows.select("*", host)
    found = marked.join(large, "host").unionByName(marked.join(large, "host", "left_anti").join(verdicts.where(F.col("n") <= HOST_ROWS), "host"))
    kept = ~F.col("base_failed") & (F.col("host_low") <= majority)
    return found.select("doc_id", *_COUNTS, "base_failed", "host_rate", "host_low", kept.alias("kept"))
