"""Profiling and whole-table queries: mapping suggestion (P4/P5), cleaning (P1/P2), whole-table
masking with audit (M11/A1/P6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import audit as AU
from ..operators import mask as M
from ..operators import profiling as PR
from ..profile import default_profile
from ..session import ensure_checkpoint_dir
from .registry import register, table
from .sqlpat import ci, profile_steps, sq

PROFILED = {
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
}


def _suggest_sql():
    parts = []
    for tbl, (key, cols) in PROFILED.items():
        for c in cols:
            parts.append(
                f"""SELECT '{tbl}' AS tbl, '{c}' AS "column", coalesce(avg(length(v)), 0.0) AS avg_len, count(*) AS n_sample
                FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {tbl} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT {PR.SAMPLE})"""
            )
    lengths = "\nUNION ALL\n".join(parts)
    kind = "'keep'"
    for k, pat in reversed(P.KIND_GUESS):
        kind = f"CASE WHEN regexp_matches(\"column\", {sq('(?i)' + pat)}) THEN '{k}' ELSE {kind} END"
    is_text = f"(regexp_matches(\"column\", {sq('(?i)' + P.HEUR_TEXT)}) OR avg_len > 150 OR \"column\" = 'texto')"
    is_struct = f"(regexp_matches(\"column\", {sq('(?i)' + P.HEUR_STRUCT)}) OR avg_len < 40)"
    role = f"CASE WHEN {is_text} THEN 'text' WHEN {is_struct} THEN 'struct' ELSE 'none' END"
    return f"""WITH l AS ({lengths}), r AS (SELECT *, {role} AS role FROM l)
SELECT tbl, "column", avg_len, n_sample, role, CASE WHEN role = 'struct' THEN {kind} END AS kind FROM r"""


@register("suggest_mapping", "P4 P5 W5", "documents customer orders", _suggest_sql())
def suggest_mapping(spark, sf):
    out = None
    for tbl, (key, cols) in PROFILED.items():
        lengths = PR.sample_lengths(table(spark, sf, tbl).select(*cols), key, tbl)
        out = lengths if out is None else out.unionByName(lengths)
    return PR.suggest(out)


_STRIP = "^" + P.PY_SPACE + "+|" + P.PY_SPACE + "+$"


@register(
    "clean_columns",
    "P1 P2",
    "pages",
    f"""SELECT page_id, regexp_replace(coalesce(url, ''), {sq(_STRIP)}, '', 'g') AS url,
       regexp_replace(coalesce(html, ''), {sq(_STRIP)}, '', 'g') AS html FROM pages""",
)
def clean_columns(spark, sf):
    return PR.clean_values(PR.clean_names(table(spark, sf, "pages")))


DOC_KINDS = {"doc_id": "keep", "lang": "cat", "source": "pii", "n_chars": "num"}
_TEXT_STEPS = [s[0] for s in profile_steps()] + ["heur"]


def _audit_sql():
    steps = profile_steps() + [("heur", ci(P.HEURISTIC_RESIDENCE), r"\1 [LOC]")]
    ctes = ["s0 AS (SELECT source, text AS t0 FROM documents)"]
    for i, (name, pat, tag) in enumerate(steps, start=1):
        ctes.append(
            f"s{i} AS (SELECT *, coalesce(len(regexp_extract_all(t{i-1}, {pat})), 0) AS n_{name}, "
            f"regexp_replace(t{i-1}, {pat}, {sq(tag)}, 'g') AS t{i} FROM s{i-1})"
        )
    total = " + ".join(f"n_{s[0]}" for s in steps)
    n = len(steps)
    return f"""WITH {', '.join(ctes)}
SELECT 'per_col' AS scope, 'text' AS key, CAST(sum({total}) AS BIGINT) AS n FROM s{n}
UNION ALL SELECT 'per_col', 'doc_id', 0 FROM (SELECT 1)
UNION ALL SELECT 'per_col', 'lang', 0 FROM (SELECT 1)
UNION ALL SELECT 'per_col', 'n_chars', 0 FROM (SELECT 1)
UNION ALL SELECT 'per_col', 'source', count(source) FROM documents
UNION ALL SELECT 'rows', 'rows', count(*) FROM documents
UNION ALL SELECT 'protected_drug_spans_total', 'total', 0 FROM (SELECT 1)"""


@register("mask_table_audit", "M11 A1 M3 P6 S9", "documents", _audit_sql())
def mask_table_audit(spark, sf):
    docs = table(spark, sf, "documents")
    prof = default_profile(text_cols=["text"], structured_types=DOC_KINDS, protect_drugs=False)
    masked, text_cols, sc = M.mask_table(docs, prof)
    return AU.audit_table(masked, text_cols, _TEXT_STEPS, sc, docs.columns)


@register("observed_audit", "A1 S10 S11 M11 (audit from the masked write itself)", "documents", _audit_sql())
def observed_audit(spark, sf):
    """Mask ``documents`` into a table of the shared folder, and report what that one pass counted."""
    docs = table(spark, sf, "documents")
    prof = default_profile(text_cols=["text"], structured_types=DOC_KINDS, protect_drugs=False)
    home = ensure_checkpoint_dir(spark).rstrip("/")
    return AU.write_masked_observed(docs, prof, f"{home}/velado-masked/{uuid.uuid4().hex}")


def _summary_sql():
    steps = profile_steps() + [("heur", ci(P.HEURISTIC_RESIDENCE), r"\1 [LOC]")]
    ctes = ["s0 AS (SELECT text, text AS t0 FROM documents)"]
    for i, (name, pat, tag) in enumerate(steps, start=1):
        ctes.append(f"s{i} AS (SELECT *, regexp_replace(t{i-1}, {pat}, {sq(tag)}, 'g') AS t{i} FROM s{i-1})")
    n = len(steps)
    return f"""WITH {', '.join(ctes)}
SELECT count(*) AS rows, 5 AS columns, count(*) * 1 AS masked_cells,
       count(*) FILTER (WHERE t{n} IS DISTINCT FROM text) AS changed_rows FROM s{n}"""


@register("run_summary", "P6 P3 (rows, columns, masked cells, changed pairs)", "documents", _summary_sql())
def run_summary(spark, sf):
    """Mask into ``text_ANON`` beside ``text`` (P3 pairs) and summarise in one aggregate."""
    docs = table(spark, sf, "documents")
    prof = default_profile(text_cols=["text_ANON"], protect_drugs=False)
    masked, _, _ = M.mask_table(docs.withColumn("text_ANON", F.col("text")), prof)
    changed = F.when(~F.col("text").eqNullSafe(F.col("text_ANON")), 1).otherwise(0)
    agg = masked.agg(F.count(F.lit(1)).alias("rows"), F.sum(changed).cast("long").alias("changed_rows"))
    return agg.select("rows", F.lit(len(docs.columns)).alias("columns"), (F.col("rows") * 1).alias("masked_cells"),
                      "changed_rows")
