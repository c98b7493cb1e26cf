"""Shared pieces of the llm operators: column selection, stored intermediates, connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a join side that may be broadcast after they were counted (some 40 bytes each: 40 MB at most).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or a local one for a local master only."""
    from velado.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lost executor costs no recompute
    of what came before, and later steps read only the columns that they need."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/velado-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done: it does so only once their plans are collected on the
    driver, which would else be long after, so that the files of all steps lay on the disks together."""
    gc.collect()  # plans that only Python still holds
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 2000) -> None:
    """Let Arrow batches hold at most ``size`` bytes and ``rows`` rows, so a task holds few texts at a time."""
    for key, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        spark.conf.set(key, str(bound))


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns; other columns never meet the operators' own names."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def row_key() -> Column:
    """Key of a document row that every scan computes alike: its id and its text. For sampling and spreading, where two
    rows may share one."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def wide_row_key() -> Column:
    """Key of 16 bytes, by which results come back to their rows: two 64-bit hashes with different seeds, so that rows of
    one key are equal rows at any size of the corpus."""
    half = lambda *cols: F.lpad(F.hex(F.xxhash64(*cols)), 16, "0")
    return F.unhex(F.concat(half("doc_id", "text"), half(F.lit(1), "text", "doc_id")))


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below ``bound``; else as it is (shuffle join)."""
    return F.broadcast(df) if df.count() <= bound else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: one row ``(node, label)`` per node, label its smallest node.

    Alternates large-star and small-star steps, so rounds grow with the logarithm of the longest path. Every
    round is stored, since its plan would double otherwise; a hot node costs pre-aggregated minima and a skew
    join, never a collected neighbour list. No edges give no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # a table, so that a hub's side can be split
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = stored(large.where("u <> v").distinct())
        low = stored(step.groupBy("u").agg(F.min("v").alias("m")))
        linked = step.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct())
        e = new
        before, seen = seen, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == seen or seen[0] == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v"))).distinct()
