"""Operator 12, language-model scoring: an interpolated modified Kneser-Ney model of the corpus.

Tokens are counted first: a token's number is its place among all tokens sorted by hash. Texts then become n-grams of
such numbers, packed into few longs, and tasks fold equal n-grams of a buffer before they emit them. One shuffle deals
the n-grams over ranges of their 64-bit key (``xxhash64`` of the packed numbers); each task sorts its range, adds up
equal keys and streams keys and counts into arrays of that range in the shared folder. The same pass gives, folded
again, what the next lower order needs (n-grams without their first token, each once: continuation counts), the sums
of every context, and the counts of counts that set the three discounts. Workers memory-map the arrays and find keys
by binary search, so no task holds a model and its size is bounded by the shared folder alone.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from typing import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velado.llm.learn import fold
from velado.llm.util import shared_dir, stored, text_rows
from velado.llm.words import LOWER, Tile, byte_values, spans_hash, tiles

ORDER = 2
FOLDS, HELD = 7, 2
#: n-grams that a task folds at a time (some 100 MB).
BUFFER = 1 << 21
#: n-grams of an array, up to MAX_BITS; beyond that arrays grow with the corpus (they are written as a stream).
SHARD_ROWS, MAX_BITS = 1 << 20, 13
#: Hash of the token after the last word; numbers of the mark before the first and of tokens without a number.
END, START, UNKNOWN = 0x1F83D9ABFB41BD6B, 0, -1
_U, _I = np.uint64, np.int64
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def xxhash64(columns: list[np.ndarray], seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of long columns (the public XXH64 of eight bytes, seeded by the column before)."""
    h = np.full(len(columns[0]) if columns else 0, seed, _U)
    turn = lambda x, r: (x << _U(r)) | (x >> _U(64 - r))
    for col in columns:
        h = h + _U((_P[4] + 8) % 2**64)
        h = h ^ (turn(col.astype(_U) * _U(_P[1]), 31) * _U(_P[0]))
        h = turn(h, 27) * _U(_P[0]) + _U(_P[3])
        h = (h ^ (h >> _U(33))) * _U(_P[1])
        h = (h ^ (h >> _U(29))) * _U(_P[2])
        h = h ^ (h >> _U(32))
    return h.astype(_I)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _I(64 - bits)) + (1 << bits >> 1) if bits else np.zeros(len(keys), _I)


def distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, in the first column's order, with the sums of the last axis of ``n``."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    cols = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.add.reduceat(n[order], at) if len(at) else n[:0]


def pack(cols: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Numbers of up to ``bits`` bits side by side in as few longs as hold them."""
    per = 62 // bits
    out = []
    for i in range(0, len(cols), per):
        x = cols[i].astype(_I)
        for c in cols[i + 1 : i + per]:
            x = (x << _I(bits)) | c
        out.append(x)
    return out


def unpack(packed: list[np.ndarray], k: int, bits: int) -> list[np.ndarray]:
    per, out = 62 // bits, []
    for i, x in zip(range(0, k, per), packed):
        n = min(per, k - i)
        out += [(x >> _I(bits * (n - 1 - j))) & _I((1 << bits) - 1) for j in range(n)]
    return out


def longs(k: int, bits: int) -> list[str]:
    """Names of the columns that hold ``k`` packed numbers."""
    return [f"p{i + 1}" for i in range(-(-k // (62 // bits)))]


def token_hashes(t: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place in its document (from 0, a mark before the first word), and document of every token; END closes each."""
    n = t.n_words + 2
    begin = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
    h = np.full(begin[-1], END, _I)
    words = spans_hash(LOWER[t.data], t.start, t.end, byte_values(21)).astype(_I)
    h[(place > 0) & (place < np.repeat(n, n) - 1)] = words
    return h, place, np.repeat(np.arange(len(t)), n)


@dataclass
class Model:
    """Where the arrays of a model lie, and its few global numbers."""

    folder: str
    order: int
    bits: int
    shards: dict[str, dict[int, int]] = field(default_factory=dict)
    discount: dict[int, np.ndarray] = field(default_factory=dict)
    tokens: int = 0
    words: int = 0
    total: float = 0.0  # of the lowest order's counts
    gamma: float = 1.0  # weight of the uniform distribution

    @property
    def number_bits(self) -> int:
        """Bits of a token's number; START is 0, and the highest stays free."""
        return max(1, (self.words + 1).bit_length())

    @property
    def count_type(self) -> type:
        return np.uint32 if self.tokens < 1 << 32 else _I

    @property
    def first_number(self) -> dict[int, int]:
        """Of each vocabulary shard, the number of its first token."""
        out, n = {}, 1
        for s in sorted(self.shards.get("v", {})):
            out[s] = n
            n += self.shards["v"][s]
        return out


@dataclass
class Tokens:
    """Token numbers of a tile, each document with START before and the end after its words."""

    number: np.ndarray
    count: np.ndarray  # in the training texts
    place: np.ndarray  # of a token in its document, 0 for START
    doc: np.ndarray

    def gram(self, k: int, at: np.ndarray) -> list[np.ndarray]:
        """Tokens of the n-grams of ``k`` that end at ``at``."""
        return [self.number[at - j] for j in range(k - 1, -1, -1)]


def _vocabulary():
    """Rows ``(key, c)``: token hashes and their counts, folded by buffers."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        out = pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "c"])
        for a in range(0, out.num_rows, 1 << 16):
            yield out.slice(a, 1 << 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in tiles(batches):
            h, place, _ = token_hashes(t)
            held.append(h[place > 0])
            size += len(h)
            if size >= BUFFER:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return work


def _count(model: Model):
    """Rows ``(lvl, packed numbers, c)``: n-grams of the top order; those of lower orders that begin a text."""
    order, bits = model.order, model.number_bits
    names = longs(order, bits)

    def emit(lvl: int, cols: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        cols, n = distinct(cols, n)
        cols = cols + [np.zeros(len(n), _I)] * (len(names) - len(cols))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), lvl, np.int32)), *map(pa.array, cols), pa.array(n)], ["lvl", *names, "c"])

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for lvl, parts in held.items():
            cols = [np.concatenate(c) for c in zip(*parts)]
            out = emit(lvl, cols, np.ones(len(cols[0]), _I))
            for a in range(0, out.num_rows, 1 << 16):
                yield out.slice(a, 1 << 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(model)
        held: dict[int, list] = {}
        size = 0
        for t in tiles(batches):
            x = tables.tokens(t)
            for lvl in range(1, order + 1):
                at = np.flatnonzero(x.place >= max(order - 1, 1) if lvl == order else (x.place == lvl - 1) & (x.place > 0))
                held.setdefault(lvl, []).append(pack(x.gram(lvl, at), bits))
            size += len(x.place)
            if size >= BUFFER:
                yield from flush(held)
                held, size = {}, 0
        if held:
            yield from flush(held)

    return work


class _Writer:
    """Streams sorted keys and values of one table into its shards' files; a shard's files appear when it is whole."""

    def __init__(self, folder: str, table: str, bits: int):
        self.folder, self.table, self.bits = folder, table, bits
        self.shard, self.files, self.rows, self.done = -1, [], 0, []

    def add(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        shards = shard_of(keys, self.bits)
        at = 0
        while at < len(keys):
            if shards[at] != self.shard:
                self.close()
                self.shard, self.rows = int(shards[at]), 0
                self.name = os.path.join(self.folder, f"{self.table}-{self.shard:05d}")
                self.temp = f"{self.name}.{uuid.uuid4().hex}"
                os.makedirs(self.folder, exist_ok=True)
                self.files = [open(f"{self.temp}.{i}", "wb") for i in range(1 + len(values))]
            to = int(np.searchsorted(shards, self.shard, "right"))
            for f, x in zip(self.files, [keys, *values]):
                f.write(np.ascontiguousarray(x[at:to]).tobytes())
            self.rows += to - at
            at = to

    def close(self) -> None:
        for i, f in enumerate(self.files):
            f.close()
            os.replace(f.name, f"{self.name}.{i}")  # a second attempt puts the same bytes there
        if self.files:
            self.done.append((self.shard, self.rows))
        self.files = []


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a sorted stream whose last is ``c``: rows that agree in all others become one, with the sum of c."""
    carry = None
    for batch in batches:
        *cols, c = (batch.column(i).to_numpy() for i in range(batch.num_columns))
        if carry is not None:
            *cols, c = (np.concatenate([a, b]) for a, b in zip(carry, (*cols, c)))
        if not len(c):
            continue
        new = np.ones(len(c), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in cols], axis=0)
        at = np.flatnonzero(new)
        rows = [*(x[at] for x in cols), np.add.reduceat(c, at)]
        carry = [x[-1:] for x in rows]
        yield [x[:-1] for x in rows]
    if carry is not None:
        yield carry


def _merge(model: Model, level: int):
    """Sorted rows ``(lvl, key, packed numbers, c)`` into the arrays of their order, and rows for what comes next.

    kind 0: an n-gram one token shorter with its continuation count; 1: a context with its sum and its numbers of
    n-grams counted once, twice, more; 2: counts of counts; 3: a shard and its rows.
    """
    order, bits = model.order, model.number_bits
    packed = longs(max(level - 1, 1), bits)
    names = ["kind", "lvl", *packed, "c", "n1", "n2", "n3", "n4"]

    def rows(kind: int, lvl: int, cols: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        cols = cols + [np.zeros(len(n), _I)] * (len(packed) - len(cols))
        n = n[:, None] if n.ndim == 1 else n
        n = np.hstack([n, np.zeros((len(n), 5 - n.shape[1]), _I)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), x, np.int32)) for x in (kind, lvl)] + [pa.array(c) for c in cols] + [pa.array(n[:, i]) for i in range(5)], names
        )

    def folded(cols: list[np.ndarray], c: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.stack([c, c == 1, c == 2, c > 2], 1).astype(_I)
        if level == 1:
            yield rows(1, level, [], n.sum(0, keepdims=True))
            return
        numbers = unpack(cols, level, bits)
        yield rows(1, level, *distinct(pack(numbers[:-1], bits), n))
        yield rows(0, level - 1, *distinct(pack(numbers[1:], bits), np.ones(len(c), _I)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(model.folder, f"n{level}", model.bits)
        counts = np.zeros(5, _I)
        buffer: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def drain() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(x) for x in zip(*(b[0] for b in buffer))]
            for out in folded(cols, np.concatenate([b[1] for b in buffer])):
                for a in range(0, out.num_rows, 1 << 16):
                    yield out.slice(a, 1 << 16)

        for lvl, key, *cols, c in _summed(batches):
            for x in np.unique(lvl):
                mine = lvl == x
                if x < level:  # beginnings of texts wait for their own order
                    yield rows(0, int(x), [y[mine] for y in cols[: len(longs(int(x), bits))]], c[mine])
                    continue
                writer.add(key[mine], [c[mine].astype(model.count_type)])
                counts[1:] += np.bincount(np.minimum(c[mine], 5), minlength=6)[1:5]
                buffer.append(([y[mine] for y in cols], c[mine]))
                size += int(mine.sum())
            if size >= BUFFER:
                yield from drain()
                buffer, size = [], 0
        if buffer:
            yield from drain()
        yield rows(2, level, [], counts[None])
        writer.close()
        if writer.done:
            done = np.array(writer.done, _I)
            yield rows(3, level, [done[:, 0]], done[:, 1])

    return work, ", ".join(["kind int", "lvl int", *(f"{c} long" for c in names[2:])])


def _words(folder: str, bits: int):
    """Sorted rows ``(key, c)`` of the vocabulary into its arrays; a row a shard with its rows and the sum of c."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, total = _Writer(folder, "v", bits), 0
        for key, c in _summed(batches):
            writer.add(key, [c])
            total += int(c.sum())
        writer.close()
        done = np.array(writer.done, _I).reshape(-1, 2)
        sums = np.zeros(len(done), _I)
        sums[:1] = total
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (done[:, 0], done[:, 1], sums)], ["shard", "n", "total"])

    return work


def _contexts(folder: str, table: str, bits: int):
    """Contexts sorted by key into arrays: their sums and their weights for the next lower order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Writer(folder, table, bits)
        for batch in batches:
            key, total, gamma = (batch.column(i).to_numpy() for i in range(3))
            w.add(key, [total, gamma])
        w.close()
        if w.done:
            done = np.array(w.done, _I)
            yield pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1])], ["shard", "n"])

    return work


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of n-grams counted 0, 1, 2, and 3 or more times, from how many are counted 1 to 4 times.

    Where a count of counts is 0 or a discount leaves its range (as on tiny corpora), 0.5, 1 and 1.5 are used.
    """
    d = [0.5, 1.0, 1.5]
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        own = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        if all(0 < x <= k + 1 for k, x in enumerate(own)):
            d = own
    return np.array([0.0, *d])


class Tables:
    """The arrays of a model, memory-mapped when a key first falls into them."""

    def __init__(self, model: Model):
        self.model, self.open, self.first = model, {}, model.first_number

    def find(self, table: str, keys: np.ndarray, kinds: tuple[type, ...], place: bool = False) -> list[np.ndarray]:
        """The values of ``keys`` in a table, 0 where it has no such key; with ``place`` also the keys' numbers."""
        want, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(want), k) for k in kinds] + [np.full(len(want), UNKNOWN, _I)] * place
        shards = shard_of(want, self.model.bits)
        for s in np.unique(shards):
            rows = self.model.shards.get(table, {}).get(int(s), 0)
            if not rows:
                continue
            if (table, s) not in self.open:
                name = os.path.join(self.model.folder, f"{table}-{s:05d}")
                self.open[table, s] = [np.memmap(f"{name}.{i}", k, "r", shape=(rows,)) for i, k in enumerate((_I, *kinds))]
            have, *values = self.open[table, s]
            a, b = np.searchsorted(shards, [s, s + 1])
            at = np.minimum(np.searchsorted(have, want[a:b]), rows - 1)
            hit = have[at] == want[a:b]
            for o, v in zip(out, values):
                o[a:b][hit] = v[at[hit]]
            if place:
                out[-1][a:b][hit] = self.first[int(s)] + at[hit]
        return [o[back] for o in out]

    def tokens(self, t: Tile) -> Tokens:
        h, place, doc = token_hashes(t)
        count, number = self.find("v", h, (_I,), place=True)
        number[place == 0], count[place == 0] = START, 0
        return Tokens(number, count, place, doc)

    def log10(self, x: Tokens) -> np.ndarray:
        """log10 probability of every token; 0 at START."""
        m = self.model
        grams = lambda k, at: xxhash64(pack(x.gram(k, at), m.number_bits))
        p = np.zeros(len(x.place))
        at = np.flatnonzero(x.place > 0)
        known = at[x.number[at] != UNKNOWN]
        p[at] = m.gamma / (m.words + 1)
        a = self.find("n1", grams(1, known), (m.count_type,))[0].astype(_I)
        p[known] += (a - m.discount[1][np.minimum(a, 3)]) / max(m.total, 1)
        for k in range(2, m.order + 1):
            at = np.flatnonzero(x.place >= k - 1)
            at = at[np.all([c != UNKNOWN for c in x.gram(k - 1, at - 1)], axis=0)]
            total, gamma = self.find(f"c{k}", grams(k - 1, at - 1), (_I, float))
            seen = total > 0
            at, total, gamma = at[seen], total[seen], gamma[seen]
            a, known = np.zeros(len(at), _I), x.number[at] != UNKNOWN
            a[known] = self.find(f"n{k}", grams(k, at[known]), (m.count_type,))[0]
            p[at] = (a - m.discount[k][np.minimum(a, 3)]) / total + gamma * p[at]
        return np.log10(p, out=np.zeros(len(p)), where=p > 0)


def _mounted(spark: SparkSession) -> str:
    """The shared folder as a path of this and all other machines; arrays are mapped, so it must be a mounted one."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {at.scheme}")
    return unquote(at.path)


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all texts of ``docs``. Null texts count as empty (they still hold their end); no rows give a model
    that knows no token."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    bits = min(MAX_BITS, max(0, (size // 6 // SHARD_ROWS).bit_length()))
    model = Model(os.path.join(_mounted(spark), "velado-llm", f"lm-{uuid.uuid4().hex}"), order, bits)
    shift = lambda key: F.shiftright(key, 64 - bits) if bits else F.lit(0)
    shards = lambda table: {r.shard: r for r in table.collect()}  # noqa: E731  a row a shard

    texts = text_rows(docs)
    words = texts.mapInArrow(_vocabulary(), "key long, c long").repartition(1 << bits, shift(F.col("key"))).sortWithinPartitions("key")
    found = shards(words.mapInArrow(_words(model.folder, bits), "shard long, n long, total long"))
    model.shards["v"] = {k: r.n for k, r in found.items()}
    model.words, model.tokens = sum(r.n for r in found.values()), sum(r.total for r in found.values())

    width = model.number_bits
    counted = texts.mapInArrow(_count(model), "lvl int, " + ", ".join(f"{p} long" for p in longs(order, width)) + ", c long")
    for level in range(order, 0, -1):
        ps, below = longs(level, width), longs(max(level - 1, 1), width)
        dealt = counted.repartition(1 << bits, F.col("lvl"), shift(F.xxhash64(*ps)))
        run = dealt.select("lvl", F.xxhash64(*ps).alias("key"), *ps, "c").sortWithinPartitions("lvl", "key", *ps)
        work, schema = _merge(model, level)
        made = stored(run.mapInArrow(work, schema))
        n = made.where("kind = 2").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4"))).first()
        d = model.discount[level] = discounts([x or 0 for x in n])
        model.shards[f"n{level}"] = {k: r.n for k, r in shards(made.where("kind = 3").select(F.col(below[0]).alias("shard"), F.col("c").alias("n"))).items()}
        sums = [F.sum(c).alias(c) for c in ("c", "n1", "n2", "n3")]
        spare = (F.col("n1") * float(d[1]) + F.col("n2") * float(d[2]) + F.col("n3") * float(d[3])) / F.col("c")
        contexts = made.where("kind = 1")
        if level == 1:
            r = contexts.agg(*sums).select("c", spare.alias("gamma")).first()
            if r.c:
                model.total, model.gamma = float(r.c), r.gamma
        else:
            table = contexts.groupBy(*below).agg(*sums).select(F.xxhash64(*below).alias("key"), "c", spare.alias("gamma"))
            table = table.repartition(1 << bits, shift(F.col("key"))).sortWithinPartitions("key")
            written = shards(table.mapInArrow(_contexts(model.folder, f"c{level}", bits), "shard long, n long"))
            model.shards[f"c{level}"] = {k: r.n for k, r in written.items()}
            counted = made.where("kind = 0").select("lvl", *below, "c")
    return model


def score(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """``doc_id``, the named columns, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row.

    Null and empty texts are their end alone. A token that the model never saw has its share of the uniform part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(model)
        for t in tiles(batches):
            x = tables.tokens(t)
            p = tables.log10(x)
            base = np.where(x.place > 0, np.log10((x.count + 1) / (model.tokens + model.words + 1)), 0.0)
            sums = lambda w: np.bincount(x.doc, w, len(t))
            known = sums((x.count > 0).astype(float)).astype(_I)
            arrays = [t.batch.column(c) for c in ("doc_id", *more)]
            arrays += [pa.array(t.n_words + 1), pa.array(known), pa.array(sums(base)), pa.array(sums(p))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *more, "n_tokens", "n_known", "base_score", "score"])

    rows = text_rows(docs, *more)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return rows.mapInArrow(work, f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def perplexity(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The model learns from the rows outside the held-out fold (crc32 of the doc_id as text, modulo 7, is 2; a null id
    counts as empty text). ``score`` is the text's log10 probability, ``base_score`` that of add-one token counts.
    Null texts are empty: one token, the end. Repeated rows count each and come back each; without training rows every
    token has probability 1; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold(FOLDS) == HELD).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), order)
    out = score(rows, model, "held_out").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
