"""Queries that read and write files of the shared folder (CSV, JSON lines, preview) or run rules that come with the
sources: profiles in their other spelling, whole values against a lexicon, allowed labels, missing annotation files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import corpus as C
from ..operators import mask as M
from ..operators import policy as PO
from ..operators import spanops as SO
from ..profile import normalize_profile
from ..session import ensure_checkpoint_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from . import q_corpus as QC
from . import q_mask as QM
from . import q_notes as QN
from . import q_spans as QS
from .registry import REGISTRY, register, table

_CUSTOMER_SQL = REGISTRY["struct_mask_customer"].sql


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/velado-files/{uuid.uuid4().hex}"


@register("masked_csv", "S1 S10 M3 (masked table written as CSV and read back)", "customer", _CUSTOMER_SQL)
def masked_csv(spark, sf):
    masked, home = QM.struct_mask_customer(spark, sf), _folder(spark)
    SK.write_masked(masked, home, "csv")
    return RD.read_table(spark, home, "csv", schema=masked.schema)


@register("masked_preview", "S12 (the first 100 masked rows by key)", "customer", f"SELECT * FROM ({_CUSTOMER_SQL}) ORDER BY c_custkey LIMIT 100")
def masked_preview(spark, sf):
    masked, home = QM.struct_mask_customer(spark, sf), _folder(spark)
    SK.write_preview(masked, home, 100, "c_custkey")
    return RD.read_table(spark, home, "csv", schema=masked.schema)


@register("training_texts", "S2 (texts of a CSV whose header has a byte-order mark)", "orders customer", f"SELECT text FROM {QN.NOTES_SQL}")
def training_texts(spark, sf):
    home = _folder(spark)
    QN.notes(spark, sf).select(F.col("text").alias("﻿text"), "o_orderkey").write.option("header", True).csv(home)
    return RD.read_texts(spark, home)


@register("spans_jsonl", "S14 D3 (spans as JSON lines, read back)", "documents", REGISTRY["detect_spans"].sql)
def spans_jsonl(spark, sf):
    spans, home = QS.detect_spans(spark, sf), _folder(spark)
    SK.write_jsonl(spans, home)
    return spark.read.schema(spans.schema).json(home)


@register("profile_spellings", "S9 M11 (a profile in its other spelling)", "orders customer", f"SELECT o_orderkey, masked FROM ({REGISTRY['mask_notes'].sql})")
def profile_spellings(spark, sf):
    raw = {"text_cols": ["text"], "structured_cols": [{"column": c, "kind": "keep"} for c in ("o_orderkey", "c_custkey", "o_orderdate")] + ["no entry"],
           "regex": dict(P.PROFILE_REGEX_DEFAULTS), "protect_drugs": False}
    masked, _, _ = M.mask_table(QN.notes(spark, sf), normalize_profile(raw))
    return masked.select("o_orderkey", F.col("text").alias("masked"))


_DRUG = QN._pick(QN.DRUGS, "o_orderkey")
_VALUE = f"CASE WHEN o_custkey % 4 = 0 THEN concat(' ', upper({_DRUG}), ' ') WHEN o_custkey % 4 = 1 THEN concat({_DRUG}, ' 10') WHEN o_custkey % 4 = 2 THEN {_DRUG} END"


@register(
    "drug_values",
    "F11p (whole values that are lexicon terms)",
    "orders",
    f"SELECT o_orderkey, lower(trim({_VALUE})) IN ({', '.join(repr(d) for d in QN.DRUGS)}) AS in_lexicon FROM orders",
)
def drug_values(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", PO.in_drug_lexicon(F.expr(_VALUE), QN.DRUGS).alias("in_lexicon"))


_LIVES, _ALLERGIC = QN.SENTENCES[6][0], QN.SENTENCES[8][0]


@register(
    "allowed_entities",
    "O4 F1p (entities of the requested labels that are allowed)",
    "orders customer",
    f"""SELECT o_orderkey, CAST({_LIVES} AS INTEGER) + CAST({_ALLERGIC} AS INTEGER) AS n_loc, CAST({_LIVES} AS INTEGER) AS n_per,
       2 * CAST({_LIVES} AS INTEGER) + CAST({_ALLERGIC} AS INTEGER) AS n FROM {QN.NOTES_SQL}""",
)
def allowed_entities(spark, sf):
    kept = PO.label_filter(F.col("entities"), PO.allowed_labels(["LOC", "ORG", "PER"]))
    d = QN.predicted_notes(spark, sf).select("o_orderkey", kept.alias("kept"))
    of = lambda label: F.size(F.filter("kept", lambda s: s["label"] == label))
    return d.select("o_orderkey", of("LOC").alias("n_loc"), of("PER").alias("n_per"), F.size("kept").alias("n"))


#: Annotation of a customer's text by kind, and the spans that the lenient rule reads from it.
_LENIENT = [
    ("concat('T1 NOMBRE 0 18 ', c_name)", [("NOMBRE", 0, 18)]),
    ("concat('T1\tNOMBRE 0 8;9 18\t', c_name)", [("NOMBRE", 0, 8)]),
    ("concat('T1 NOMBRE x 18 ', c_name, '\nT2   OTRO 3   5 x')", [("OTRO", 3, 5)]),
    ("concat('T1 NOMBRE 0 9999 ', c_name, '\r\nT2\tLUGAR 19 23\tvive')", [("LUGAR", 19, 23)]),
    ("concat('R1 Rel 0 5 ', c_name)", []),
]
_LENIENT_ANN = "CASE " + " ".join(f"WHEN c_custkey % {len(_LENIENT)} = {i} THEN {x}" for i, (x, _) in enumerate(_LENIENT)) + " END"


@register(
    "lenient_spans",
    "S6 (annotations without tabs, first segment alone)",
    "customer",
    " UNION ALL ".join(f"SELECT c_custkey, '{lab}' AS label, {a} AS start, {b} AS \"end\" FROM customer WHERE c_custkey % {len(_LENIENT)} = {i}"
                       for i, (_, found) in enumerate(_LENIENT) for lab, a, b in found),
)
def lenient_spans(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.expr(QC._PERSON_TEXT).alias("text"), F.expr(_LENIENT_ANN).alias("ann"))
    d = c.select("c_custkey", C.parse_ann(F.col("ann"), F.col("text"), lenient=True).alias("spans"))
    return SO.explode_spans(d, "spans", ["c_custkey"]).select("c_custkey", "label", "start", "end")


@register(
    "files_without_ann",
    "J2 (texts whose annotation file is missing; an empty file is none of them)",
    "orders customer",
    """SELECT CASE WHEN c_custkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split, concat('c', c_custkey) AS stem, 'NO_ANN' AS reason
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')""",
)
def files_without_ann(spark, sf):
    """One annotation file a customer with urgent orders, of one line if one of them is open; the other files are empty."""
    line = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("T1\tPEDIDO 0 8\t"), F.col("o_orderkey").cast("string")))
    files = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.coalesce(F.max(line), F.lit("")).alias("ann"))
    key = F.col("o_custkey")
    files = files.select(F.when(key % 4 == 0, "dev").otherwise("train").alias("split"), F.concat(F.lit("c"), key.cast("string")).alias("stem"), "ann")
    return C.without_annotations(QC._annotated(spark, sf).drop("ann"), files)


@register(
    "corpus_union",
    "O1 S5 A4 (two corpora as one, with repeated rows)",
    "customer supplier",
    """SELECT label, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT 'NOMBRE' AS label, length(c_name) AS chars FROM customer UNION ALL SELECT 'EMPRESA', length(s_name) FROM supplier
  UNION ALL SELECT 'EMPRESA', length(s_name) FROM supplier) GROUP BY label""",
)
def corpus_union(spark, sf):
    def corpus(name, column, label):
        ann = F.format_string(f"T1\t{label} 0 %d\t%s", F.length(column), F.col(column))
        return table(spark, sf, name).select(F.col(column).alias("text"), ann.alias("ann"))

    firms = corpus("supplier", "s_name", "EMPRESA")
    d = corpus("customer", "c_name", "NOMBRE").unionByName(firms).unionByName(firms)
    rows = S.explode_rows(d.withColumn("spans", C.parse_ann(F.col("ann"), F.col("text"))), F.col("spans"), []).select("s.*")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))
