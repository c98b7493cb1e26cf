"""Query registry: each query is a Spark builder ``(spark, sf_dir) -> DataFrame`` with an optional
DuckDB oracle SQL over the same parquet tables (views named after the tables)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str
    tables: str


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: str, tables: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, operators, tables)
        return fn

    return deco


# Keys that spread the rows of the text tables evenly.
SPREAD_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"], "orders": ["o_orderkey"], "customer": ["c_custkey"]}
# Session setting: hash-repartition the text tables into so many partitions.  Unset (as on a cluster,
# where the scan has splits enough) they are read as they are.  Bench and tests set it, since their
# files are one row group, which is one task.
SPREAD_CONF = "spark.velado.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SPREAD_CONF, None)
    return df.repartition(int(parts), *SPREAD_KEYS[name]) if parts and name in SPREAD_KEYS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Stand-in rows made from a small table, over as many partitions as the session has cores: a text table of the real
    size would have at least as many splits."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), *keys)
