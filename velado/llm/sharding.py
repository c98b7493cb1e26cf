"""Operator 7, sharding by bytes: a minimax contiguous partition of ordered atomic groups.

Equal texts form a group and never part. Groups are ordered by their 64-bit text hash and atoms are ranges of
that hash, so an atom holds whole groups; 2^``atom_bits`` bounds what the driver sees, whatever the input. The smallest
feasible shard capacity is found by binary search over the atom sizes, each value checked by one greedy pass, and
the atoms are cut there. All row work is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ATOM_BITS = 15
CELLS = 512


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Shards that a greedy pass opens if none may exceed ``capacity`` (each size is at most that)."""
    used, room = 1, capacity
    for s in sizes:
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which ``shards`` contiguous runs hold all sizes, and each run's first index.

    No sizes give capacity 0 and only the first run. A size larger than an even share sets the capacity.
    """
    low, high = max([-(-sum(sizes) // shards), *sizes], default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if shards_needed(sizes, mid) <= shards:
            high = mid
        else:
            low = mid + 1
    starts, room = [0], low
    for i, s in enumerate(sizes):
        if s > room:
            starts.append(i)
            room = low
        room -= s
    return low, starts


def shard_by_bytes(docs: DataFrame, shards: int = 8, atom_bits: int = ATOM_BITS, cells: int = CELLS) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document row.

    size: UTF-8 bytes plus 1 (null text: 1, crc 0); null texts are a group of their own. Repeated rows each get a
    row. An empty table gives no rows. Other columns are ignored. ``slot`` counts from 0 in each shard: rows are
    numbered within (shard, cell), a cell being a hash of the id, and the cells' counts (shards x cells rows)
    are summed up before; so a shard is never one task, nor is a group of copies.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftright(F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")), 64 - atom_bits).cast("int").alias("atom"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(cells)).cast("int").alias("cell"),
    )
    sums = {r.atom: r.b for r in rows.groupBy("atom").agg(F.sum("size").alias("b")).collect()}
    ordered = sorted(sums)
    _, starts = minimax_cuts([sums[a] for a in ordered], shards)
    bounds = [ordered[i] for i in starts[1:]]
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("atom") >= F.lit(b)).cast("int")
    placed = rows.withColumn("shard", shard)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("number", number).join(F.broadcast(base), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
