"""Readers (S1-S4, S8): tables, text CSV, stand-off corpora, term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import read_corpus  # noqa: F401  (S3/S4/J1)
from ..operators.lexicon import read_lists  # noqa: F401  (S8/O2)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Tabular source with a header row (S1).  Parquet by default; CSV infers types unless a
    schema is given.  (The spreadsheet codec itself is not built.)"""
    if fmt == "csv":
        r = spark.read.option("header", True).option("encoding", "UTF-8")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        df = r.csv(path)
        return strip_bom_header(df)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def strip_bom_header(df: DataFrame) -> DataFrame:
    """Remove a UTF-8 byte-order mark from the first column name."""
    cols = df.columns
    if cols and cols[0].startswith("﻿"):
        return df.withColumnRenamed(cols[0], cols[0].lstrip("﻿"))
    return df


def read_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """Training-text CSV with a ``text`` column (S2): BOM stripped from the header, column checked."""
    df = read_table(spark, path, "csv", schema=None)
    if column not in df.columns:
        raise ValueError(f"CSV must have a {column!r} column, found {df.columns}")
    return df.select(F.col(column).cast("string").alias(column))
