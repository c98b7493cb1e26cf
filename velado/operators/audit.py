"""Audit of a masking run (A1): long table ``(scope, key, n)`` plus JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import spans as S


def _sums(text_cols, text_step_names, struct_count_cols, all_cols):
    """The aggregates of an audit, and for each the ``(scope, key)`` that it is reported under."""
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    aggs = [(F.count(F.lit(1)).cast("long"), "rows", "rows")]
    for c in text_cols:
        aggs.append((total(sum((F.col(f"__tc_{c}.{n}") for n in text_step_names), F.lit(0))), "per_col", c))
    aggs.append((total(sum((F.col(f"__tc_{c}.protected") for c in text_cols), F.lit(0))), "protected_drug_spans_total", "total"))
    for c in all_cols:
        if c not in text_cols:
            aggs.append((total(F.col(f"__sc_{c}") if f"__sc_{c}" in struct_count_cols else F.lit(0)), "per_col", c))
    return aggs


def audit_table(masked: DataFrame, text_cols, text_step_names, struct_count_cols, all_cols) -> DataFrame:
    """One aggregate over the masked table's count columns (one pass, partial aggregation).

    ``per_col``: text columns = sum of all their detections; every other column = its structured
    count (0 for keep/num/cat, absent kinds also 0).  ``rows``: row count.  ``protected``: total
    protected medication spans.
    """
    aggs = _sums(text_cols, text_step_names, struct_count_cols, all_cols)
    one = masked.agg(*(a.alias(f"a{i}") for i, (a, _, _) in enumerate(aggs)))
    rows = [F.struct(F.lit(s).alias("scope"), F.lit(k).alias("key"), F.col(f"a{i}").alias("n")) for i, (_, s, k) in enumerate(aggs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def write_masked_observed(df: DataFrame, profile, path: str, protect: bool | None = None, mode: str = "errorifexists") -> DataFrame:
    """Mask a table by profile and write it to ``path`` (M11, S10); the audit rows come from that write itself.

    The sums are observed while the rows are written, so the table is read and masked once and every written row is
    counted, whatever the table holds when somebody looks at it later.  Null counts count as 0; an empty table gives
    zeros.  Returns the audit rows ``(scope, key, n)``, as ``audit_table`` does.
    """
    from . import mask as M

    masked, text_cols, struct_cols = M.mask_table(df, profile, protect)
    steps = [n for n, _, _ in M.T.text_steps(profile)]
    aggs = _sums(text_cols, steps, struct_cols, df.columns)
    seen = Observation()
    observed = masked.observe(seen, *(a.alias(f"a{i}") for i, (a, _, _) in enumerate(aggs)))
    observed.select(*df.columns).write.mode(mode).parquet(path)
    got = seen.get
    rows = [(s, k, int(got.get(f"a{i}") or 0)) for i, (_, s, k) in enumerate(aggs)]
    return df.sparkSession.createDataFrame(rows, "scope string, key string, n long")


def per_entity(masked: DataFrame, counts: str) -> DataFrame:
    """``(scope, key, n)`` rows ``per_ent``: how often each entity label was masked in the whole table."""
    one = S.explode_rows(masked, F.col(f"{counts}.ents"), [], "key")
    return one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("per_ent").alias("scope"), "key", "n")


def write_audit(audit: DataFrame, profile_dict: dict, out_dir: str, run_id: str) -> None:
    """Audit rows and the normalised profile (sizes only, never sample values) under ``run_id``."""
    import json

    spark = audit.sparkSession
    audit.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(f"{out_dir}/summary")
    spark.createDataFrame([(run_id, json.dumps(profile_dict, ensure_ascii=False))], "run_id string, profile string") \
        .write.mode("append").partitionBy("run_id").json(f"{out_dir}/profile")
