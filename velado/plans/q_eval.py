"""Evaluation queries on derived gold (hard regexes) and predicted (looser detectors) spans:
strict (E1/E3), per label (E4), leakage with split summary (E5/E6), greedy IoU (E2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import evaluate as EV
from ..operators import spanops as SO
from . import q_spans as QS
from .registry import register, table

GOLD_SET = QS.DETECT_SET
PRED_SET = [
    ("EMAIL", P.PROFILE_REGEX_DEFAULTS["email"], True),
    ("IP", P.EXTRA_REGEX["ip"], False),
    ("CARD", r"\b\d{13,19}\b", False),
    ("SECRET", r"\b[0-9a-f]{40}\b", False),
    ("PHONE", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}", False),
]


def gold_pred(spark, sf, keep=("doc_id", "lang", "text")):
    docs = table(spark, sf, "documents").select(*keep)
    d = S.with_detector_spans(docs, "text", [QS._java(x) for x in GOLD_SET], "gold_raw")
    d = S.with_detector_spans(d, "text", [QS._java(x) for x in PRED_SET], "pred_raw")
    return d.withColumn("gold", S.merge_spans(F.col("gold_raw"), label="PHI")) \
            .withColumn("pred", S.merge_spans(F.col("pred_raw"), label="PHI"))


def _islands_sql(dets, name):
    return f"""{name}_sp AS (SELECT doc_id, start, max("end") AS "end" FROM {QS.spans_sql(dets)} GROUP BY doc_id, start),
{name}_w AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {name}_sp),
{name}_i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM {name}_w),
{name} AS (SELECT doc_id, min(start) AS s, max("end") AS e FROM {name}_i GROUP BY doc_id, island)"""


_STRICT_CTE = f"""{_islands_sql(GOLD_SET, 'gold')},
{_islands_sql(PRED_SET, 'pred')},
j AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.s IS NOT NULL AS in_g, p.s IS NOT NULL AS in_p
      FROM gold g FULL OUTER JOIN pred p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e),
c AS (SELECT d.doc_id, d.lang,
             count(*) FILTER (WHERE in_g AND in_p) AS tp,
             count(*) FILTER (WHERE in_p AND NOT in_g) AS fp,
             count(*) FILTER (WHERE in_g AND NOT in_p) AS fn
      FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id, d.lang)"""

_PRF = """coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r,
       coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0)
                / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0) AS f1"""


@register(
    "eval_strict",
    "E1 E3 J5 V1",
    "documents",
    f"""WITH {_STRICT_CTE}
SELECT doc_id, CAST(tp + fn AS INTEGER) AS gold_spans, CAST(tp + fp AS INTEGER) AS pred_spans,
       CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, {_PRF} FROM c""",
)
def eval_strict(spark, sf):
    d = gold_pred(spark, sf).withColumn("c", EV.strict_counts(F.col("gold"), F.col("pred")))
    p, r, f1 = EV.prf(F.col("c.tp"), F.col("c.fp"), F.col("c.fn"))
    return d.select("doc_id", F.size("gold").alias("gold_spans"), F.size("pred").alias("pred_spans"),
                    "c.tp", "c.fp", "c.fn", p.alias("p"), r.alias("r"), f1.alias("f1"))


def _iou_sql():
    iou = ("CASE WHEN (g.e - g.s) + (x.e - x.s) - greatest(0, least(g.e, x.e) - greatest(g.s, x.s)) > 0 "
           "THEN greatest(0, least(g.e, x.e) - greatest(g.s, x.s)) / "
           "((g.e - g.s) + (x.e - x.s) - greatest(0, least(g.e, x.e) - greatest(g.s, x.s))) ELSE 0.0 END")
    return f"""WITH RECURSIVE {_islands_sql(GOLD_SET, 'gold')},
{_islands_sql(PRED_SET, 'pred')},
g AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM gold),
pl AS (SELECT doc_id, list({{'s': s, 'e': e, 'j': j}} ORDER BY j) AS preds
       FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS j FROM pred) GROUP BY doc_id),
r AS (SELECT d.doc_id, 0 AS k, CAST([] AS BIGINT[]) AS used, 0 AS tp FROM documents d
      UNION ALL
      SELECT doc_id, k, CASE WHEN hit THEN list_append(used, best.j) ELSE used END, tp + CASE WHEN hit THEN 1 ELSE 0 END
      FROM (SELECT r.doc_id, r.k + 1 AS k, r.used, r.tp, b.best,
                   b.best IS NOT NULL AND -b.best.nv >= 0.5 AS hit
            FROM r JOIN g ON g.doc_id = r.doc_id AND g.k = r.k + 1
            LEFT JOIN pl ON pl.doc_id = r.doc_id,
            LATERAL (SELECT list_min(list_transform(list_filter(coalesce(pl.preds, []), lambda x: NOT list_contains(r.used, x.j)),
                                                    lambda x: {{'nv': -({iou}), 'j': x.j}})) AS best) b)),
fin AS (SELECT doc_id, tp FROM r QUALIFY k = max(k) OVER (PARTITION BY doc_id)),
n AS (SELECT d.doc_id, (SELECT count(*) FROM gold WHERE gold.doc_id = d.doc_id) AS ng,
             (SELECT count(*) FROM pred WHERE pred.doc_id = d.doc_id) AS np FROM documents d),
c AS (SELECT n.doc_id, fin.tp, n.np - fin.tp AS fp, n.ng - fin.tp AS fn FROM n JOIN fin ON fin.doc_id = n.doc_id)
SELECT doc_id, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, {_PRF} FROM c"""


@register("eval_iou", "E2 J6", "documents", _iou_sql())
def eval_iou(spark, sf):
    d = gold_pred(spark, sf).withColumn("c", EV.iou_counts(F.col("gold"), F.col("pred"), 0.5))
    p, r, f1 = EV.prf(F.col("c.tp"), F.col("c.fp"), F.col("c.fn"))
    return d.select("doc_id", "c.tp", "c.fp", "c.fn", p.alias("p"), r.alias("r"), f1.alias("f1"))


#: Word groups whose spans overlap, nest and repeat: a gold span has several predictions and the other way round.
GOLD_GROUPS = [("A", r"[A-Za-z]{5,} [A-Za-z]{5,}", False), ("B", r"[a-z]{6,} [a-z]{5,}", False)]
PRED_GROUPS = [("ONE", r"[A-Za-z]{8,}", False), ("TWO", r"[A-Za-z]{4,} [A-Za-z]{4,}", False), ("PAIR", r"[a-z]{5,} [a-z]{4,}", False),
               ("THREE", r"[A-Za-z]{6,} [A-Za-z]+ [A-Za-z]{3,}", False)]

_IOU_ROWS_SQL = f"""WITH RECURSIVE g AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS i
  FROM (SELECT doc_id, start AS s, "end" AS e FROM {QS.spans_sql(GOLD_GROUPS)})),
p AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS j
  FROM (SELECT doc_id, start AS s, "end" AS e FROM {QS.spans_sql(PRED_GROUPS)})),
pair AS (SELECT g.doc_id, g.i, p.j, (least(g.e, p.e) - greatest(g.s, p.s)) / (greatest(g.e, p.e) - least(g.s, p.s)) AS v
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.s < g.e AND g.s < p.e),
want AS (SELECT doc_id, list(j ORDER BY v DESC, j) AS js, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM pair WHERE v >= 0.5 GROUP BY doc_id, i),
r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM want
  UNION ALL SELECT doc_id, k, CASE WHEN len(f) > 0 THEN list_append(used, f[1]) ELSE used END
  FROM (SELECT r.doc_id, w.k, r.used, list_filter(w.js, lambda x: NOT list_contains(r.used, x)) AS f
        FROM r JOIN want w ON w.doc_id = r.doc_id AND w.k = r.k + 1)),
tp AS (SELECT doc_id, max(len(used)) AS tp FROM r GROUP BY doc_id),
n AS (SELECT doc_id, sum(ng) AS ng, sum(np) AS np FROM (SELECT doc_id, 1 AS ng, 0 AS np FROM g UNION ALL SELECT doc_id, 0, 1 FROM p) GROUP BY doc_id)
SELECT n.doc_id, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(np - coalesce(tp, 0) AS BIGINT) AS fp, CAST(ng - coalesce(tp, 0) AS BIGINT) AS fn
FROM n LEFT JOIN tp ON tp.doc_id = n.doc_id"""


@register("eval_iou_rows", "E2 J6 (row form: candidates by cells, one-to-one match over sorted runs)", "documents", _IOU_ROWS_SQL)
def eval_iou_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = []
    for dets in (GOLD_GROUPS, PRED_GROUPS):
        rows.append(SO.explode_spans(S.with_detector_spans(docs, "text", [QS._java(x) for x in dets], "sp"), "sp", ["doc_id"]))
    return EV.iou_counts_rows(*rows, ["doc_id"])


def _per_label_sql():
    return f"""WITH g AS (SELECT DISTINCT doc_id, start, "end", label FROM {QS.spans_sql(GOLD_SET)}),
p AS (SELECT DISTINCT doc_id, start, "end", label FROM {QS.spans_sql(PRED_SET)}),
j AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS in_g, p.doc_id IS NOT NULL AS in_p
      FROM g FULL OUTER JOIN p ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end" AND g.label = p.label),
c AS (SELECT label, count(*) FILTER (WHERE in_g AND in_p) AS tp, count(*) FILTER (WHERE in_p AND NOT in_g) AS fp,
             count(*) FILTER (WHERE in_g AND NOT in_p) AS fn FROM j GROUP BY label),
a AS (SELECT * FROM c UNION ALL SELECT '__overall__', sum(tp), sum(fp), sum(fn) FROM c)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_PRF} FROM a"""


@register("eval_per_label", "E4 J5", "documents", _per_label_sql())
def eval_per_label(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    d = S.with_detector_spans(docs, "text", [QS._java(x) for x in GOLD_SET], "g")
    d = S.with_detector_spans(d, "text", [QS._java(x) for x in PRED_SET], "p")
    return EV.per_label(d, "g", "p")


@register(
    "eval_leak",
    "E5 E6 A9 M2",
    "documents",
    f"""WITH {_STRICT_CTE},
g2 AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS pe,
              row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS rdesc FROM pred),
pieces AS (SELECT g2.doc_id, g2.s AS ord, substr(d.text, g2.pe + 1, g2.s - g2.pe) || '[PHI]' ||
                  CASE WHEN g2.rdesc = 1 THEN substr(d.text, g2.e + 1) ELSE '' END AS piece
           FROM g2 JOIN documents d ON d.doc_id = g2.doc_id),
m AS (SELECT d.doc_id, coalesce(p.masked, d.text) AS masked
      FROM documents d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY ord) AS masked FROM pieces GROUP BY doc_id) p
      ON p.doc_id = d.doc_id),
x AS (SELECT g.doc_id, count(*) AS exposed FROM gold g JOIN documents d ON d.doc_id = g.doc_id JOIN m ON m.doc_id = g.doc_id
      WHERE g.e > g.s AND strpos(m.masked, substr(d.text, g.s + 1, g.e - g.s)) > 0 GROUP BY g.doc_id),
per AS (SELECT c.*, coalesce(x.exposed, 0) AS exposed FROM c LEFT JOIN x ON x.doc_id = c.doc_id),
s AS (SELECT lang, count(*) AS docs, count(*) FILTER (WHERE exposed = 0) AS docs_fully_anonymized,
             sum(tp + fn) AS gold_spans, sum(tp + fp) AS pred_spans, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
             sum(exposed) AS total_exposed FROM per GROUP BY lang)
SELECT lang, docs, docs_fully_anonymized, docs_fully_anonymized / docs AS rate_docs_fully_anonymized,
       CAST(gold_spans AS BIGINT) AS gold_spans, CAST(pred_spans AS BIGINT) AS pred_spans, CAST(total_exposed AS BIGINT) AS total_exposed,
       coalesce(total_exposed / nullif(gold_spans, 0), 0.0) AS span_exposure_rate, {_PRF} FROM s""",
)
def eval_leak(spark, sf):
    d = gold_pred(spark, sf)
    d, blk = S.with_blocks(d, "text")
    d = d.withColumn("masked", S.pinned(blk, S.replace_spans(F.col("text"), F.col("pred"), "[PHI]", blocks=F.col(blk))))
    d = d.withColumn("exposed", S.pinned(blk, EV.exposed_count(F.col("text"), F.col("gold"), F.col("masked"), F.col(blk))))
    d = d.withColumn("c", EV.strict_counts(F.col("gold"), F.col("pred")))
    s = d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.when(F.col("exposed") == 0, 1).otherwise(0)).alias("docs_fully_anonymized"),
        F.sum(F.size("gold")).cast("long").alias("gold_spans"), F.sum(F.size("pred")).cast("long").alias("pred_spans"),
        F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn"),
        F.sum("exposed").cast("long").alias("total_exposed"),
    )
    p, r, f1 = EV.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(
        "lang", "docs", "docs_fully_anonymized", (F.col("docs_fully_anonymized") / F.col("docs")).alias("rate_docs_fully_anonymized"),
        "gold_spans", "pred_spans", "total_exposed",
        F.coalesce(F.col("total_exposed") / F.nullif(F.col("gold_spans"), F.lit(0)), F.lit(0.0)).alias("span_exposure_rate"),
        p.alias("p"), r.alias("r"), f1.alias("f1"),
    )
