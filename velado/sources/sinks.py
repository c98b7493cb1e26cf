"""Sinks (S10-S15): masked table, audit, preview, rejects, JSON lines, annotation files.

Every sink is a distributed write; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import write_audit  # noqa: F401  (S11)
from ..operators.corpus import ann_lines

REJECT_COLUMNS = ["split", "file", "label", "start", "end", "reason", "first", "last", "frag", "context"]


def write_masked(df: DataFrame, path: str, fmt: str = "parquet", dry_run: bool = False, mode: str = "errorifexists") -> None:
    """Masked table in input column order (S10); count columns (``__*``) are dropped; nothing under dry run."""
    if dry_run:
        return
    out = df.select(*[c for c in df.columns if not c.startswith("__")])
    w = out.write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_preview(df: DataFrame, path: str, n: int, order_by) -> None:
    """First ``n`` rows by an explicit key (S12): a bounded top-k, deterministic."""
    df.select(*[c for c in df.columns if not c.startswith("__")]).orderBy(order_by).limit(n) \
        .write.mode("overwrite").option("header", True).csv(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Tab-separated reject report with the ten reference columns (S13); tabs/newlines in text become spaces.  A line
    number, where the rows have one, follows the file's name after a colon."""
    if "line_no" in rejects.columns:
        rejects = rejects.withColumn("file", F.concat_ws(":", "file", "line_no"))
    cols = []
    for c in REJECT_COLUMNS:
        v = F.col(c).cast("string") if c in rejects.columns else F.lit("")
        cols.append(F.regexp_replace(F.coalesce(v, F.lit("")), r"[\t\r\n]", " ").alias(c))
    w = rejects.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True)
    # The writer trims by default, and a blank edge is what many rejects are about.
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines (S14), UTF-8, one object per row."""
    df.write.mode("overwrite").json(path)


def write_ann(docs: DataFrame, spans: str, text: str, path: str, partition: str | None = None) -> None:
    """Annotation text per document ``T{i}\\tLABEL s e\\tsurface`` (S15), one row per document."""
    out = docs.withColumn("ann", ann_lines(F.col(spans), F.col(text))).drop(spans)
    w = out.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
