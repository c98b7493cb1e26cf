"""Masking queries over the driver tables: free text (M8/D1/D5/D6/F8p), protection (M6/M7/D14),
rules-first (M9/D2), structured cells (M3-M5), whole table + audit (M11/A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import mask as M
from ..profile import default_profile
from .registry import register, table
from .sqlpat import ci, profile_steps, re2, sq

STEP_NAMES = [k for k in P.REGEX_ORDER if P.PROFILE_REGEX_DEFAULTS.get(k)] + list(P.EXTRA_REGEX)


def _count_cols(counts: str, names):
    return [F.col(f"{counts}.{n}").alias(f"n_{n}") for n in names]


def _sql_chain(source_sql: str, text_col: str, steps, keep_cols: str):
    """Nested CTE chain: each step counts on its input and replaces (DuckDB oracle)."""
    ctes = [f"s0 AS (SELECT {keep_cols}, {text_col} AS t0 FROM {source_sql})"]
    for i, (name, pat, tag) in enumerate(steps, start=1):
        ctes.append(
            f"s{i} AS (SELECT *, coalesce(len(regexp_extract_all(t{i-1}, {pat})), 0) AS n_{name}, "
            f"regexp_replace(t{i-1}, {pat}, {sq(tag)}, 'g') AS t{i} FROM s{i-1})"
        )
    return "WITH " + ",\n".join(ctes), len(steps)


# ---------------------------------------------------------------------------------------------
# mask_documents (flagship): default profile regexes + extra keys + residence heuristic.
# ---------------------------------------------------------------------------------------------
def _mask_documents_sql():
    steps = profile_steps() + [("heur", ci(P.HEURISTIC_RESIDENCE), r"\1 [LOC]")]
    head, n = _sql_chain("documents", "text", steps, "doc_id, lang")
    names = [s[0] for s in steps]
    total = " + ".join(f"n_{x}" for x in names)
    cols = ", ".join(f"n_{x}" for x in names)
    return f"{head}\nSELECT doc_id, lang, t{n} AS masked, {cols}, ({total}) AS n_total FROM s{n}"


@register("mask_documents", "M8 D1 D6 F8p A2", "documents", _mask_documents_sql())
def mask_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    prof = default_profile()
    df = M.mask_text(docs, "text", prof, out="masked", counts="c", protect=False)
    names = STEP_NAMES + ["heur"]
    return df.select(
        "doc_id", "lang", "masked", *_count_cols("c", names), M.count_total("c", names).alias("n_total")
    )


# ---------------------------------------------------------------------------------------------
# regex_counts_by_lang: detections per language and key (A1 over D1).
# ---------------------------------------------------------------------------------------------
def _counts_by_lang_sql():
    steps = profile_steps()
    head, n = _sql_chain("documents", "text", steps, "lang")
    sums = ", ".join(f"sum(n_{s[0]}) AS n_{s[0]}" for s in steps)
    total = " + ".join(f"n_{s[0]}" for s in steps)
    return (
        f"{head}\nSELECT lang, count(*) AS docs, {sums}, sum({total}) AS n_total, "
        f"sum(CASE WHEN ({total}) > 0 THEN 1 ELSE 0 END) AS docs_with_hits FROM s{n} GROUP BY lang"
    )


@register("regex_counts_by_lang", "D1 A1", "documents", _counts_by_lang_sql())
def regex_counts_by_lang(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    prof = default_profile()
    df = M.mask_text(docs, "text", prof, out="masked", counts="c", protect=False).drop("masked")
    tot = M.count_total("c", STEP_NAMES)
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(F.col(f"c.{n}")).alias(f"n_{n}") for n in STEP_NAMES],
        F.sum(tot).alias("n_total"),
        F.sum(F.when(tot > 0, 1).otherwise(0)).alias("docs_with_hits"),
    )


# ---------------------------------------------------------------------------------------------
# rules_first_conversations: notebook rules (DNI, NIE, phone) then extra keys, on chat turns.
# ---------------------------------------------------------------------------------------------
def _rules_first_sql():
    steps = []
    for name, pat, tag, icase in P.RULES_FIRST:
        steps.append((name, ci(pat) if icase else sq(re2(pat)), tag))
    for key, pat in P.EXTRA_REGEX.items():
        steps.append((key, ci(pat), P.EXTRA_TAGS[key]))
    head, n = _sql_chain("conversations", "text", steps, "conv_id, turn, role")
    cols = ", ".join(f"n_{s[0]}" for s in steps)
    return f"{head}\nSELECT conv_id, turn, role, t{n} AS masked, {cols} FROM s{n}"


@register("rules_first_conversations", "M9 D2 P3", "conversations", _rules_first_sql())
def rules_first_conversations(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    steps = [(n, P.ci(p) if ic else P.cs(p), tag) for n, p, tag, ic in P.RULES_FIRST]
    steps += [(k, P.ci(p), P.EXTRA_TAGS[k]) for k, p in P.EXTRA_REGEX.items()]
    df = M.regex_chain_df(conv, "text", steps, "masked", "c")
    return df.select("conv_id", "turn", "role", "masked", *_count_cols("c", [s[0] for s in steps]))


# ---------------------------------------------------------------------------------------------
# Structured cells by kind (M3, M4, M5) on orders and customer.
# ---------------------------------------------------------------------------------------------
ORDERS_KINDS = {
    "o_orderkey": "keep",
    "o_custkey": "nhc",
    "o_orderstatus": "cat",
    "o_totalprice": "num",
    "o_orderdate": "date",
    "o_orderpriority": "pii",
}
CUSTOMER_KINDS = {
    "c_custkey": "keep",
    "c_name": "name",
    "c_nationkey": "cat",
    "c_acctbal": "num",
    "c_mktsegment": "email",
}


@register(
    "struct_mask_orders",
    "M3 M4 M5",
    "orders",
    """SELECT o_orderkey,
       CASE WHEN o_custkey IS NULL THEN NULL ELSE '[X]' END AS o_custkey,
       o_orderstatus, o_totalprice,
       CAST(year(o_orderdate) AS VARCHAR) AS o_orderdate,
       CASE WHEN o_orderpriority IS NULL THEN NULL ELSE '[X]' END AS o_orderpriority,
       (CASE WHEN o_custkey IS NULL THEN 0 ELSE 1 END) + (CASE WHEN o_orderdate IS NULL THEN 0 ELSE 1 END)
       + (CASE WHEN o_orderpriority IS NULL THEN 0 ELSE 1 END) AS n_masked
FROM orders""",
)
def struct_mask_orders(spark, sf):
    prof = default_profile(structured_types=ORDERS_KINDS)
    df, _, cnt = M.mask_table(table(spark, sf, "orders"), prof)
    total = sum((F.col(c) for c in cnt[1:]), F.col(cnt[0]))
    return df.select(*ORDERS_KINDS, total.alias("n_masked"))


_EMAIL_RE2 = ci(P.PROFILE_REGEX_DEFAULTS["email"])


@register(
    "struct_mask_customer",
    "M3 M4",
    "customer",
    f"""SELECT c_custkey,
       CASE WHEN c_name IS NULL THEN NULL ELSE '[NOMBRE]' END AS c_name,
       c_nationkey, c_acctbal,
       CASE WHEN c_mktsegment IS NULL THEN NULL
            WHEN len(regexp_extract_all(c_mktsegment, {_EMAIL_RE2})) > 0
                 THEN regexp_replace(c_mktsegment, {_EMAIL_RE2}, '[EMAIL]', 'g')
            ELSE '[X]' END AS c_mktsegment,
       (CASE WHEN c_name IS NULL THEN 0 ELSE 1 END)
       + (CASE WHEN c_mktsegment IS NULL THEN 0
               ELSE greatest(len(regexp_extract_all(c_mktsegment, {_EMAIL_RE2})), 1) END) AS n_masked
FROM customer""",
)
def struct_mask_customer(spark, sf):
    prof = default_profile(structured_types=CUSTOMER_KINDS)
    df, _, cnt = M.mask_table(table(spark, sf, "customer"), prof)
    total = sum((F.col(c) for c in cnt[1:]), F.col(cnt[0]))
    return df.select(*CUSTOMER_KINDS, total.alias("n_masked"))


