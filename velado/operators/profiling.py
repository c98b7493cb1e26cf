"""Column profiling and cleaning: name clean-up (P1), null/trim (P2), masked pairs (P3),
mapping suggestion (P4), kind guess (P5), run summary (P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P

SAMPLE = 50


def clean_names(df: DataFrame) -> DataFrame:
    """Trim column names and drop columns whose name starts with ``Unnamed``."""
    import re

    pairs = [(c, c.strip()) for c in df.columns]
    kept = [(c, n) for c, n in pairs if not re.match(r"^Unnamed", n)]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in kept])


def py_strip(c):
    """``str.strip()``: remove Python whitespace from both ends (Unicode separators included)."""
    return F.regexp_replace(c, "^" + P.PY_SPACE + "+|" + P.PY_SPACE + "+$", "")


def clean_values(df: DataFrame) -> DataFrame:
    """Null to ``''`` and strip every string column (P2); other types untouched."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(py_strip(F.coalesce(F.col(f.name), F.lit(""))).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sample_lengths(df: DataFrame, key: str, table_name: str = "", sample: int = SAMPLE) -> DataFrame:
    """Mean string length of the first ``sample`` non-null values of each column, by ``key`` order.

    One bounded top-k per column (``orderBy(key).limit``, each reading only ``key`` and the column),
    unioned: no column's values are ever gathered in one task beyond ``sample`` rows.
    """
    parts = []
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        top = df.select(F.col(key), v.alias("v")).filter(F.col("v").isNotNull()).orderBy(key).limit(sample)
        parts.append(
            top.agg(F.coalesce(F.avg(F.length("v")), F.lit(0.0)).alias("avg_len"), F.count(F.lit(1)).alias("n_sample"))
            .select(F.lit(table_name).alias("tbl"), F.lit(c).alias("column"), "avg_len", "n_sample")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suggest(lengths: DataFrame) -> DataFrame:
    """Role by name pattern and mean length (P4) and kind guess by name (P5)."""
    name = F.col("column")
    is_text = name.rlike("(?i)" + P.HEUR_TEXT) | (F.col("avg_len") > 150) | (name == "texto")
    is_struct = name.rlike("(?i)" + P.HEUR_STRUCT) | (F.col("avg_len") < 40)
    role = F.when(is_text, "text").when(is_struct, "struct").otherwise("none")
    kind = F.lit("keep")
    for k, pat in reversed(P.KIND_GUESS):
        kind = F.when(name.rlike("(?i)" + pat), F.lit(k)).otherwise(kind)
    return lengths.withColumn("role", role).withColumn("kind", F.when(role == "struct", kind))


def run_summary(df: DataFrame, masked_cols) -> DataFrame:
    """Rows, columns and masked cells (P6) in one aggregate."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(n_cols).alias("columns"), (F.col("rows") * len(masked_cols)).alias("masked_cells")
    )
