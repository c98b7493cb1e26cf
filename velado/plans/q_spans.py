"""Span queries: extraction (D3), merging (V1 array/row), adjacent overlaps (V14), right clip (V4),
edge trim (V5), union with generic label (V3), merged-span masking (M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import spanops as SO
from .registry import register, table
from .sqlpat import re2, sq

# Detection set on documents: the hard evaluation regexes plus our extra keys.
DETECT_SET = [(lab, p, ic) for lab, p, ic in P.HARD_REGEXES] + [
    ("IP", P.EXTRA_REGEX["ip"], False),
    ("CARD", P.EXTRA_REGEX["card"], False),
    ("SECRET", P.EXTRA_REGEX["secret"], True),
]
# A looser detector whose spans overlap the others: digit runs with separators.
NUMERIC_RUN = ("NUM", r"\d+(?:[.\-/ ]\d+)*", False)
# Address-like spans (label CALLE) to exercise the right clip: a capitalised word and up to 6 more.
ADDRESS_LIKE = ("CALLE", r"\b[A-Z][a-z]+(?:[ ,;.]+[a-z]+){1,6}", False)
# Loose non-space runs, to exercise edge trimming.
NONSPACE = ("RUN", r"[^ \n]*[#&%$*!.,;:]+[^ \n]*", False)


def _java(det):
    lab, p, ic = det
    return (lab, P.ci(p) if ic else P.cs(p))


def _re2(det):
    lab, p, ic = det
    return lab, sq(("(?i)" if ic else "") + re2(p))


def spans_sql(dets, source="documents", key="doc_id", text="text"):
    """DuckDB: one row per match with code-point offsets (unnest + running sum of gap/match lengths)."""
    parts = []
    for det, (lab, pat) in enumerate(_re2(d) for d in dets):
        parts.append(
            f"""SELECT {key} AS doc_id, '{lab}' AS label, {det} AS det, i, m[i] AS surface,
                   sum(len(g[i]) + len(m[i])) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING)
                     - len(m[i]) AS start_
            FROM (SELECT {key}, m, g, generate_subscripts(m, 1) AS i
                  FROM (SELECT {key}, regexp_extract_all(coalesce({text}, ''), {pat}) AS m,
                               string_split_regex(coalesce({text}, ''), {pat}) AS g FROM {source}))"""
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""(SELECT doc_id, label, CAST(start_ AS INTEGER) AS start,
                CAST(start_ + len(surface) AS INTEGER) AS "end", surface, det, i FROM ({union}))"""


def _detect(spark, sf, dets):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    d = S.with_detector_spans(docs, "text", [_java(x) for x in dets], "spans")
    return d


# ---------------------------------------------------------------------------------------------
@register(
    "detect_spans",
    "D3 V15 S-extract",
    "documents",
    f'SELECT doc_id, label, start, "end", surface FROM {spans_sql(DETECT_SET)}',
)
def detect_spans(spark, sf):
    d = _detect(spark, sf, DETECT_SET)
    rows = SO.explode_spans(d, "spans", ["doc_id"], text="text")
    return rows.select("doc_id", "label", "start", "end", "surface")


MERGE_SET = DETECT_SET + [NUMERIC_RUN]

_MERGE_SQL = f"""WITH sp AS (SELECT doc_id, start, max("end") AS "end" FROM {spans_sql(MERGE_SET)} GROUP BY doc_id, start),
w AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end"
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, island"""


@register("merge_spans_array", "V1 V2 W4 (array form)", "documents", _MERGE_SQL)
def merge_spans_array(spark, sf):
    d = _detect(spark, sf, MERGE_SET).select("doc_id", S.merge_spans(F.col("spans")).alias("m"))
    return S.explode_rows(d, F.col("m"), ["doc_id"]).select("doc_id", "s.start", "s.end")


@register("merge_spans_rows", "V1 W2 (row form, windows)", "documents", _MERGE_SQL)
def merge_spans_rows(spark, sf):
    rows = SO.explode_spans(_detect(spark, sf, MERGE_SET), "spans", ["doc_id"])
    return SO.merge_rows(rows).select("doc_id", "start", "end")


@register(
    "span_overlaps",
    "V14 W2",
    "documents",
    f"""WITH sp AS (SELECT doc_id, label, start, "end" FROM {spans_sql(MERGE_SET)}),
l AS (SELECT *, lag(start) OVER w AS prev_start, lag("end") OVER w AS prev_end, lag(label) OVER w AS prev_label
      FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", label))
SELECT doc_id, label, start, "end", prev_label, prev_start, prev_end FROM l WHERE prev_end > start""",
)
def span_overlaps(spark, sf):
    rows = SO.explode_spans(_detect(spark, sf, MERGE_SET), "spans", ["doc_id"])
    return SO.adjacent_overlaps(rows).select("doc_id", "label", "start", "end", "prev_label", "prev_start", "prev_end")


def _clip_sql():
    cuts = ", ".join(
        f"CASE WHEN strpos(surface, {sq(s)}) > 0 THEN strpos(surface, {sq(s)}) - 1 END" for s in P.CLIP_STOPS
    )
    return f"""WITH sp AS (SELECT doc_id, label, start, "end", surface FROM {spans_sql([ADDRESS_LIKE])}),
c AS (SELECT *, least({cuts}) AS cut FROM sp)
SELECT doc_id, start, "end" AS end_before,
       CASE WHEN cut IS NULL OR cut <= 0 THEN "end" ELSE start + cut END AS "end"
FROM c"""


@register("span_clip", "V4", "documents", _clip_sql())
def span_clip(spark, sf):
    d, blk = S.with_blocks(_detect(spark, sf, [ADDRESS_LIKE]), "text")
    d = d.withColumn(
        "clipped",
        S.pinned(blk, F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end_before"),
            S.clip_right(F.col("text"), s, P.CLIP_LABELS, P.CLIP_STOPS, F.col(blk)).alias("end")))),
    )
    return S.explode_rows(d, F.col("clipped"), ["doc_id"]).select("doc_id", "s.start", "s.end_before", "s.end")


_EDGE_RE2 = r"[\s\p{Z}\p{P}\x{200B}\x{FEFF}]"


@register(
    "span_trim",
    "V5 V7",
    "documents",
    f"""WITH sp AS (SELECT doc_id, start, "end", surface FROM {spans_sql([NONSPACE])}),
a AS (SELECT *, len(regexp_extract(surface, '^{_EDGE_RE2}*')) AS lead FROM sp),
b AS (SELECT *, len(regexp_extract(substr(surface, lead + 1), '{_EDGE_RE2}*$')) AS trail FROM a)
SELECT doc_id, start AS start_before, "end" AS end_before, start + lead AS start,
       greatest(start + lead, "end" - trail) AS "end",
       (start + lead) < greatest(start + lead, "end" - trail) AS kept
FROM b""",
)
def span_trim(spark, sf):
    d, blk = S.with_blocks(_detect(spark, sf, [NONSPACE]), "text")
    d = d.withColumn(
        "t",
        S.pinned(blk, F.transform(
            "spans",
            lambda s: F.struct(
                s["start"].alias("start_before"), s["end"].alias("end_before"),
                S.trim_span(F.col("text"), s, blocks=F.col(blk)).alias("n"),
            ),
        )),
    )
    r = S.explode_rows(d, F.col("t"), ["doc_id"], "x")
    return r.select(
        "doc_id", "x.start_before", "x.end_before", F.col("x.n.start").alias("start"), F.col("x.n.end").alias("end"),
        (F.col("x.n.start") < F.col("x.n.end")).alias("kept"),
    )


@register(
    "mask_merged_phi",
    "V3 M2",
    "documents",
    f"""WITH sp AS (SELECT doc_id, start, max("end") AS "end" FROM {spans_sql(MERGE_SET)} GROUP BY doc_id, start),
w AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end"
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w),
m AS (SELECT doc_id, min(start) AS s, max("end") AS e FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS pe,
             row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS rdesc FROM m),
pieces AS (SELECT g.doc_id, g.s AS ord,
                  substr(d.text, g.pe + 1, g.s - g.pe) || '[PHI]' ||
                  CASE WHEN g.rdesc = 1 THEN substr(d.text, g.e + 1) ELSE '' END AS piece
           FROM g JOIN documents d ON d.doc_id = g.doc_id)
SELECT d.doc_id, coalesce(p.masked, d.text) AS masked, coalesce(p.n, 0) AS n_spans
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY ord) AS masked, count(*) AS n
                            FROM pieces GROUP BY doc_id) p ON p.doc_id = d.doc_id""",
)
def mask_merged_phi(spark, sf):
    d = _detect(spark, sf, MERGE_SET).withColumn("m", S.merge_spans(F.col("spans"), label="PHI"))
    d, blk = S.with_blocks(d, "text")
    return d.select(
        "doc_id",
        S.pinned(blk, S.replace_spans(F.col("text"), F.col("m"), "[PHI]", blocks=F.col(blk))).alias("masked"),
        F.size("m").alias("n_spans"),
    )


# Exposed for other query modules (derived gold / predicted span sets).
def detect_frame(spark, sf, dets):
    return _detect(spark, sf, dets)


