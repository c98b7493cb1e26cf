"""What the trained operators share: the held-out rule, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def sample_labels(labels: DataFrame, label: str, parts: int, held: int, per_class: int) -> DataFrame:
    """``doc_id, label``: at most ``per_class`` labelled ids of each value outside the held-out fold, lowest hash of
    the id first. One label a document (the highest, if rows repeat); null ids and labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = rows.where(fold(parts) != held)
    pick = [rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return pick[0].union(pick[1])


def one_row(rows: DataFrame, keys: list[str], value: str = "text") -> DataFrame:
    """One row for each value of ``keys``: the one whose ``value`` has the lowest hash (null values count last). Repeats
    are folded in each task before the shuffle, so a hot key is a row a task."""
    rest = F.struct(F.xxhash64(value).alias("hash"), *[c for c in rows.columns if c not in keys])
    found = rows.groupBy(*keys).agg(F.min(F.struct(F.col(value).isNull().alias("none"), rest.alias("rest"))).alias("first"))
    return found.select(*keys, "first.rest.*").select(*rows.columns)
