"""Operator 2, best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Documents are tokenised, ended by id 0, and cut into pieces only if longer than a sequence. Everything after that
sees only the histogram of piece lengths (``size`` numbers, whatever the input): patterns of one to three lengths
that fill a sequence are enumerated, repeat counts are fitted to the histogram by projected gradient steps, and
rounded down; the lengths left over are packed best-fit, longest first, again as patterns with repeats. A piece
then finds its place by its number among the pieces of its length. Numbers are given per (length, salt), so a
length that a third of all pieces share is not one task.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velado.llm.bpe import codec, default_path
from velado.llm.util import row_key, stored, text_rows
from velado.llm.words import tiles

SIZE, END_ID, SALTS = 2048, 0, 64


def cut_lengths(n: int, size: int = SIZE) -> list[int]:
    """Piece lengths of a document of n ids: whole sequences, and what remains as the first piece."""
    rest = n % size
    return ([rest] if rest else []) + [size] * (n // size)


def enumerate_patterns(lengths: np.ndarray, size: int = SIZE, grid: int = 96) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence to within ``size / 256`` ids.

    Pairs: each length with the largest that fits beside it. Triples: two lengths from a grid of at most ``grid``
    values of the histogram, and the largest that fits beside both.
    """
    slack = size // 256
    out = [np.array([[size, 0, 0]])] if len(lengths) and lengths[-1] == size else []
    lengths = lengths[lengths < size]

    def fitting(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        room = size - first - second
        at = np.searchsorted(lengths, room, "right") - 1
        third = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
        keep = (room - third <= slack) & (third > 0)
        return np.stack([first, second, third], 1)[keep]

    if len(lengths):
        out.append(fitting(lengths, np.zeros_like(lengths)))
        picked = lengths[np.unique(np.linspace(0, len(lengths) - 1, grid).astype(int))]
        a, b = np.meshgrid(lengths, picked)
        near = (a + b < size) & (a >= b)
        out.append(fitting(a[near], b[near]))
    rows = -np.sort(-np.concatenate(out), axis=1) if out else np.zeros((0, 3), int)
    return np.unique(rows, axis=0)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeats r minimising the squared misfit of the patterns' lengths to the histogram."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    column = np.repeat(np.arange(len(patterns)), used.sum(1))
    row = patterns[used]
    weight = np.bincount(row, minlength=len(histogram)).astype(float)
    target = histogram.astype(float)
    r = np.bincount(column, (target / np.maximum(weight, 1))[row], len(patterns)) / used.sum(1)
    momentum, t = r.copy(), 1.0
    rate = 1.0 / max(3.0 * weight.max(), 1.0)
    for _ in range(steps):
        misfit = np.bincount(row, momentum[column], len(histogram)) - target
        new = np.maximum(momentum - rate * np.bincount(column, misfit[row], len(patterns)), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, r, t = new + (t - 1) / t2 * (new - r), new, t2
    return r


def best_fit(left: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that hold all lengths of the histogram ``left``: longest first, each filled with the
    longest that still fit; a pattern repeats as long as its lengths last."""
    left = left.copy()
    plan = []
    top = len(left) - 1
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top <= 0:
            return plan
        pattern, room = [], size
        while room > 0 and len(fits := np.flatnonzero(left[1 : min(room, top) + 1])):
            pick = int(fits[-1]) + 1
            left[pick] -= 1
            pattern.append(pick)
            room -= pick
        more = min(int(left[x]) // pattern.count(x) for x in set(pattern))
        for x in pattern:
            left[x] -= more
        repeat = 1 + more
        plan.append((tuple(pattern), repeat))


def pack_plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that hold every length of the histogram exactly once each.

    The fitted repeats are rounded down, to the nearest, and to nothing but whole tens; each rounding is packed up
    with its residuals, and the plan with the fewest sequences is taken.
    """
    patterns = enumerate_patterns(np.flatnonzero(histogram), size)
    fitted = fit_repeats(patterns, histogram)
    plans = [_rounded(patterns, r, histogram, size) for r in (np.floor(fitted + 1e-6), np.rint(fitted), np.floor(fitted / 10) * 10)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _rounded(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    left, plan = histogram.astype(np.int64).copy(), []
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 1:
            break
        pattern = tuple(int(x) for x in patterns[k] if x)
        need = np.bincount(pattern, minlength=len(left))
        n = min(int(repeats[k]), *(int(left[x]) // int(need[x]) for x in set(pattern)))
        if n > 0:
            left -= n * need
            plan.append((pattern, n))
    return plan + best_fit(left, size)


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each place of each pattern: the length, the first number among that length's pieces, repeats, the
    first sequence id, and the offset."""
    rows, taken, sequence = [], {}, 0
    for pattern, repeats in plan:
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), repeats, sequence, offset))
            taken[length] = taken.get(length, 0) + repeats
            offset += length
        sequence += repeats
    return pd.DataFrame(rows, columns=["length", "start", "repeats", "sequence", "offset"]).sort_values(["length", "start"])


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """``doc_id, key, piece, start, length, ids_crc32`` (and ``ids`` if asked) of every document's pieces."""
    path = path or default_path()
    end = np.array([END_ID], "<i4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            encode = codec(path).id_bytes
            for d in range(len(t)):
                raw = encode(t.text(d)) + end
                at = 0
                for p, n in enumerate(cut_lengths(len(raw) // 4, size)):
                    part = raw[4 * at : 4 * (at + n)]
                    rows.append(d)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    at += n
            take = pa.array(rows, pa.int64())
            columns = [t.batch.column("doc_id").take(take), t.batch.column("key").take(take), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        codec(path).units.forget()  # the worker lives on

    rows = text_rows(docs).withColumn("key", row_key())
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(work, f"doc_id {kind}, key long, piece int, start long, length long, ids_crc32 long{more}")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences hold at most ``size`` ids without gaps.

    A null or empty text is the one id 0. Repeated rows are packed each. An empty table gives no rows. Other
    columns are ignored. Sequence ids are 0, 1, 2, ... in the plan's order.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, path, size, with_ids))
    salt = F.pmod(F.xxhash64("key", "piece"), F.lit(SALTS)).cast("int").alias("salt")
    cells = rows.groupBy("length", salt).agg(F.count("*").alias("n")).toPandas()
    cells = cells.sort_values(["length", "salt"]).reset_index(drop=True)
    cells["base"] = cells.groupby("length")["n"].cumsum() - cells["n"]
    totals = cells.groupby("length")["n"].sum()
    histogram = np.zeros(size + 1, np.int64)
    histogram[totals.index.to_numpy(int)] = totals.to_numpy()
    slots = slot_table(pack_plan(histogram, size))
    # Both tables are bounded by the sequence size alone: size x SALTS cells, and the plan's places.
    plan = spark.sparkContext.broadcast((cells[["length", "salt", "base"]].to_numpy(np.int64), slots.to_numpy(np.int64)))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece")).cast("long").alias("number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, slot = plan.value
        wide = 1 << 40
        cell_key = cell[:, 0] * SALTS + cell[:, 1]
        slot_key = slot[:, 0] * wide + slot[:, 1]
        for b in batches:
            length, salt_of = b.column("length").to_numpy(), b.column("salt").to_numpy()
            rank = b.column("number").to_numpy() - 1 + cell[np.searchsorted(cell_key, length * SALTS + salt_of), 2]
            s = slot[np.searchsorted(slot_key, length * wide + rank, "right") - 1]
            out = b.drop_columns(["salt", "number", "key"])
            yield out.append_column("sequence_id", pa.array(s[:, 3] + rank - s[:, 1])).append_column("offset", pa.array(s[:, 4]))

    numbered = rows.select("*", salt).select("*", number)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "key")
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")
