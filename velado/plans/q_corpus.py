"""Corpus queries on annotation text derived from the documents: write annotation lines (S15),
parse them back (S5, skipping relation and malformed lines), pivot first value per label (A8),
label counts (A4), corpus report (A3), edge validation (V8), sequential span selection (V9-V12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import corpus as C
from ..operators import spanops as SO
from ..operators import tokens as TK
from ..session import ensure_checkpoint_dir
from ..sources import sinks as SK
from . import q_notes as QN
from . import q_spans as QS
from .registry import register, spread, table
from .sqlpat import sq
from .q_tokens import tokens_sql

# Lines that every parser must skip: a relation, a malformed entity, a note.
EXTRA_LINES = "R1\tRel Arg1:T1 Arg2:T2\nT0\tBROKEN x y\tz\n#1\tAnnotatorNotes T1\tnote\nT99\tEMPTY 5 5\tnothing"
LABELS = ["CARD", "DATE", "EMAIL", "ID", "IP", "PHONE", "SECRET", "URL"]


def annotated(spark, sf):
    """Documents with a derived annotation text (gold = hard-regex detections)."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    d = S.with_detector_spans(docs, "text", [QS._java(x) for x in QS.DETECT_SET], "gold")
    d, blk = S.with_blocks(d, "text")
    ann = F.concat_ws("\n", S.pinned(blk, C.ann_lines(F.col("gold"), F.col("text"), F.col(blk))), F.lit(EXTRA_LINES))
    return d.withColumn("ann", ann).drop("gold", blk)


def parsed_rows(spark, sf, with_surface=False):
    d = annotated(spark, sf).withColumn("spans", C.parse_ann(F.col("ann"), F.col("text")))
    return SO.explode_spans(d, "spans", ["doc_id", "lang"], text="text" if with_surface else None)


@register(
    "ann_roundtrip",
    "S15 S5 T10",
    "documents",
    f'SELECT doc_id, label, start, "end" FROM {QS.spans_sql(QS.DETECT_SET)}',
)
def ann_roundtrip(spark, sf):
    return parsed_rows(spark, sf).select("doc_id", "label", "start", "end")


def _first_by_label_sql():
    cols = ", ".join(
        f"coalesce(arg_max(surface, CAST(start AS BIGINT) * 1000000000 + \"end\") FILTER (WHERE label = '{lab}'), '') AS \"{lab}\""
        for lab in LABELS
    )
    return f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels_present, {cols}
FROM {QS.spans_sql(QS.DETECT_SET)} GROUP BY doc_id"""


@register("first_by_label", "A8 (pivot)", "documents", _first_by_label_sql())
def first_by_label(spark, sf):
    """Annotation files whose lines run from the last span to the first: the first of a label in the file
    is the last in the text."""
    d = annotated(spark, sf)
    d = d.withColumn("ann", F.array_join(F.reverse(F.split("ann", "\n")), "\n"))
    d = d.withColumn("spans", C.parse_ann(F.col("ann"), F.col("text"), file_order=True))
    rows = SO.explode_spans(d, "spans", ["doc_id", "lang"], text="text", with_index=True)
    return C.first_by_label(rows, LABELS, order="i")


@register(
    "label_counts",
    "A4 S7",
    "documents",
    f'SELECT label, count(*) AS n FROM {QS.spans_sql(QS.DETECT_SET)} GROUP BY label',
)
def label_counts(spark, sf):
    return parsed_rows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _report_sql():
    return f"""WITH RECURSIVE sp AS (SELECT doc_id, start, "end", label,
            row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", det, i) AS k FROM {QS.spans_sql(QS.DETECT_SET)}),
r AS (SELECT doc_id, k, start, "end", "end" AS last_end, TRUE AS kept FROM sp WHERE k = 1
      UNION ALL
      SELECT sp.doc_id, sp.k, sp.start, sp."end", CASE WHEN sp.start >= r.last_end THEN sp."end" ELSE r.last_end END,
             sp.start >= r.last_end
      FROM r JOIN sp ON sp.doc_id = r.doc_id AND sp.k = r.k + 1),
t AS (SELECT * FROM {tokens_sql('documents', 'doc_id')}),
kept AS (SELECT r.doc_id, r.start, r."end",
                EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id AND t.start < r."end" AND r.start < t."end") AS aligned
         FROM r WHERE kept),
per AS (SELECT d.doc_id, d.lang,
               (SELECT count(*) FROM sp WHERE sp.doc_id = d.doc_id) AS n_spans,
               (SELECT count(*) FROM kept WHERE kept.doc_id = d.doc_id) AS n_kept,
               (SELECT count(*) FROM kept WHERE kept.doc_id = d.doc_id AND NOT kept.aligned) AS n_mis
        FROM documents d),
labs AS (SELECT d.lang, string_agg(DISTINCT sp.label, ',' ORDER BY sp.label) AS labels
         FROM sp JOIN documents d ON d.doc_id = sp.doc_id GROUP BY d.lang)
SELECT per.lang AS split, count(*) AS docs, sum(n_kept - n_mis) AS ents, coalesce(any_value(labs.labels), '') AS labels,
       sum(n_spans - n_kept) AS skipped_overlaps, sum(n_mis) AS misaligned
FROM per LEFT JOIN labs ON labs.lang = per.lang GROUP BY per.lang"""


@register("corpus_report", "A3 V9 V13 J1", "documents", _report_sql())
def corpus_report(spark, sf):
    d = annotated(spark, sf).withColumn("spans", C.parse_ann(F.col("ann"), F.col("text")))
    d = TK.with_tokens(d, "text", "toks")
    d = d.withColumn("kept", S.select_first(F.col("spans")))
    # A span no token touches cannot be aligned (the role of a failed expand alignment).
    d = d.withColumn("misaligned", S.pinned("toks", F.size(F.filter(F.col("kept"), lambda s: ~F.exists(
        F.col("toks"), lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))))))
    # One row per document and label (an empty document has a null one); counts are added once per document.
    d = d.select("lang", F.size("kept").alias("n_kept"), "misaligned", F.size("spans").alias("n_spans"),
                 F.array_distinct(F.transform("spans", lambda s: s["label"])).alias("labels"))
    d = d.select("*", F.posexplode_outer("labels").alias("k", "label"))
    once = lambda c: F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, c).otherwise(0))
    per = d.groupBy("lang", "label").agg(
        once(F.lit(1)).alias("docs"), once(F.col("n_kept") - F.col("misaligned")).alias("ents"),
        once(F.col("n_spans") - F.col("n_kept")).alias("skipped"), once(F.col("misaligned")).alias("mis"))
    return per.groupBy(F.col("lang").alias("split")).agg(
        F.sum("docs").alias("docs"), F.sum("ents").alias("ents"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.sum("skipped").alias("skipped_overlaps"), F.sum("mis").alias("misaligned"))


_SP = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _validate_sql():
    chk = r"regexp_replace(regexp_replace(surface, '\x{A0}', ' ', 'g'), '[\x{200B}\x{FEFF}]', '', 'g')"
    sp_punct = "^(?:" + _SP + r"|[\p{Z}\p{P}\x{200B}\x{FEFF}])$"
    return f"""WITH sp AS (SELECT doc_id, start, "end", {chk} AS chk FROM {QS.spans_sql([QS.NONSPACE])}),
r AS (SELECT CASE WHEN chk = '' THEN 'empty-after-normalize'
                  WHEN regexp_matches(substr(chk, 1, 1), {sq('^' + _SP + '$')}) OR regexp_matches(substr(chk, -1, 1), {sq('^' + _SP + '$')}) THEN 'isspace-edge'
                  WHEN regexp_matches(substr(chk, 1, 1), {sq(sp_punct)}) OR regexp_matches(substr(chk, -1, 1), {sq(sp_punct)}) THEN 'space/punct-edge'
                  WHEN chk <> regexp_replace(chk, {sq('^' + _SP + '+|' + _SP + '+$')}, '', 'g') THEN 'strip-differs'
                  ELSE 'ok' END AS reason FROM sp)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""


@register("span_validate", "V8 V7 S13", "documents", _validate_sql())
def span_validate(spark, sf):
    d = QS.detect_frame(spark, sf, [QS.NONSPACE])
    rows = SO.explode_spans(d, "spans", ["doc_id"], text="text")
    return rows.select(F.coalesce(C.edge_reason(F.col("surface")), F.lit("ok")).alias("reason")) \
        .groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _select(spark, sf, fn):
    d = QS.detect_frame(spark, sf, QS.MERGE_SET).withColumn("kept", fn(F.col("spans")))
    return S.explode_rows(d, F.col("kept"), ["doc_id"]).select("doc_id", "s.start", "s.end", "s.label")


# Oracles for the sequential rules: recursive CTEs over each document's spans in Spark's order
# (start, end, then detector and match order, as the stable array sort keeps them).
_ORDERED = f"""sp AS (SELECT doc_id, start, "end", label,
                      row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", det, i) AS k FROM {QS.spans_sql(QS.MERGE_SET)})"""

_SCAN_SQL = f"""WITH RECURSIVE {_ORDERED},
r AS (SELECT doc_id, k, start, "end", label, "end" AS last_end, TRUE AS kept FROM sp WHERE k = 1
      UNION ALL
      SELECT sp.doc_id, sp.k, sp.start, sp."end", sp.label,
             CASE WHEN sp.start >= r.last_end THEN sp."end" ELSE r.last_end END, sp.start >= r.last_end
      FROM r JOIN sp ON sp.doc_id = r.doc_id AND sp.k = r.k + 1)
SELECT doc_id, start, "end", label FROM r WHERE kept"""

_REPLACE_SQL = f"""WITH RECURSIVE {_ORDERED},
r AS (SELECT doc_id, k, [{{'s': start, 'e': "end", 'l': label}}] AS kept FROM sp WHERE k = 1
      UNION ALL
      SELECT sp.doc_id, sp.k,
             CASE WHEN sp.start < r.kept[-1].e AND r.kept[-1].s < sp."end"
                  THEN CASE WHEN sp."end" - sp.start > r.kept[-1].e - r.kept[-1].s
                            THEN list_append(r.kept[1:len(r.kept) - 1], {{'s': sp.start, 'e': sp."end", 'l': sp.label}})
                            ELSE r.kept END
                  ELSE list_append(r.kept, {{'s': sp.start, 'e': sp."end", 'l': sp.label}}) END
      FROM r JOIN sp ON sp.doc_id = r.doc_id AND sp.k = r.k + 1),
last AS (SELECT doc_id, kept FROM r QUALIFY k = max(k) OVER (PARTITION BY doc_id))
SELECT doc_id, x.s AS start, x.e AS "end", x.l AS label FROM (SELECT doc_id, unnest(kept) AS x FROM last)"""

_LONGEST_SQL = f"""WITH RECURSIVE sp AS (SELECT doc_id, start, "end", label,
          row_number() OVER (PARTITION BY doc_id ORDER BY "end" - start DESC, start, det, i) AS k
          FROM {QS.spans_sql(QS.MERGE_SET)}),
r AS (SELECT doc_id, k, [{{'s': start, 'e': "end", 'l': label}}] AS kept FROM sp WHERE k = 1
      UNION ALL
      SELECT sp.doc_id, sp.k,
             CASE WHEN len(list_filter(r.kept, lambda x: sp.start < x.e AND x.s < sp."end")) > 0 THEN r.kept
                  ELSE list_append(r.kept, {{'s': sp.start, 'e': sp."end", 'l': sp.label}}) END
      FROM r JOIN sp ON sp.doc_id = r.doc_id AND sp.k = r.k + 1),
last AS (SELECT doc_id, kept FROM r QUALIFY k = max(k) OVER (PARTITION BY doc_id))
SELECT doc_id, x.s AS start, x.e AS "end", x.l AS label FROM (SELECT doc_id, unnest(kept) AS x FROM last)"""


@register("span_select_first", "V9 (keep first, drop later overlaps)", "documents", _SCAN_SQL)
def span_select_first(spark, sf):
    return _select(spark, sf, S.select_first)


@register("span_select_longest", "V10 (longest first, ties by start)", "documents", _LONGEST_SQL)
def span_select_longest(spark, sf):
    return _select(spark, sf, S.select_longest)


@register("span_select_end_pointer", "V12 (sorted, start >= last end)", "documents", _SCAN_SQL)
def span_select_end_pointer(spark, sf):
    return _select(spark, sf, S.select_end_pointer)


@register("span_select_replace_longer", "V11 (replace previous if longer)", "documents", _REPLACE_SQL)
def span_select_replace_longer(spark, sf):
    return _select(spark, sf, S.select_replace_longer)


def _template_sql(seed=42):
    from ..functions import patterns as PT

    def lst(xs):
        return "[" + ", ".join(sq(x) for x in xs) + "]"

    def h(tag):
        return f"('0x' || substr(md5(concat_ws('|', '{seed}', {sq(tag)}, CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT"

    def pick(xs, tag):
        return f"{lst(xs)}[({h(tag)} % {len(xs)}) + 1]"

    a, b = PT.TEMPLATE_MIX[0], PT.TEMPLATE_MIX[0] + PT.TEMPLATE_MIX[1]
    tmpl = (f"CASE WHEN k = 1 THEN {pick(PT.TEMPLATES_1, 't')} WHEN k = 2 THEN {pick(PT.TEMPLATES_2, 't')} "
            f"ELSE {pick(PT.TEMPLATES_3, 't')} END")
    fill = "tmpl"
    for name, values in (("{dx}", PT.TEMPLATE_DIAGNOSES), ("{motivo}", PT.TEMPLATE_REASONS),
                         ("{dosis}", PT.TEMPLATE_DOSES), ("{via}", PT.TEMPLATE_ROUTES)):
        fill = f"replace({fill}, {sq(name)}, {pick(values, name)})"
    ranked = (f"list_transform(list_sort(list_transform({lst(PT.TEMPLATE_DRUGS)}, "
              f"lambda x: {{'r': md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR), x)), 'd': x}})), lambda y: y.d)")
    return f"""WITH a AS (SELECT doc_id, CASE WHEN {h('k')} % 100 < {a} THEN 1 WHEN {h('k')} % 100 < {b} THEN 2 ELSE 3 END AS k
           FROM documents),
b AS (SELECT doc_id, k, {tmpl} AS tmpl, {ranked}[1:k] AS drugs FROM a),
c AS (SELECT doc_id, k, drugs, {fill} AS t0 FROM b),
f1 AS (SELECT *, strpos(t0, '{{f1}}') - 1 AS s1, replace(t0, '{{f1}}', drugs[1]) AS t1 FROM c),
f2 AS (SELECT *, CASE WHEN strpos(t1, '{{f2}}') > 0 THEN strpos(t1, '{{f2}}') - 1 END AS s2,
              CASE WHEN strpos(t1, '{{f2}}') > 0 THEN replace(t1, '{{f2}}', drugs[2]) ELSE t1 END AS t2 FROM f1),
f3 AS (SELECT *, CASE WHEN strpos(t2, '{{f3}}') > 0 THEN strpos(t2, '{{f3}}') - 1 END AS s3,
              CASE WHEN strpos(t2, '{{f3}}') > 0 THEN replace(t2, '{{f3}}', drugs[3]) ELSE t2 END AS t3 FROM f2)
SELECT doc_id, t3 AS text,
       concat_ws(chr(10),
         'T1' || chr(9) || 'FARMACO ' || s1 || ' ' || (s1 + length(drugs[1])) || chr(9) || drugs[1],
         CASE WHEN s2 IS NOT NULL THEN 'T2' || chr(9) || 'FARMACO ' || s2 || ' ' || (s2 + length(drugs[2])) || chr(9) || drugs[2] END,
         CASE WHEN s3 IS NOT NULL THEN 'T3' || chr(9) || 'FARMACO ' || s3 || ' ' || (s3 + length(drugs[3])) || chr(9) || drugs[3] END) AS ann,
       CAST(1 + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS INTEGER) AS n_ents
FROM f3"""


@register("template_corpus", "T11 S15 (template augmentation, one sentence per document)", "documents", _template_sql())
def template_corpus(spark, sf):
    from ..operators import augment as AG

    docs = table(spark, sf, "documents").select("doc_id")
    d = AG.templated(docs, "doc_id", seed=42)
    return d.select("doc_id", F.col("synth_text").alias("text"), F.col("synth_ann").alias("ann"),
                    F.size("synth_spans").alias("n_ents"))


@register(
    "span_align",
    "V13 (strict / contract / expand token alignment)",
    "documents",
    f"""WITH sp AS (SELECT doc_id, start, "end" FROM {QS.spans_sql([QS.NONSPACE])}),
t AS (SELECT * FROM {tokens_sql('documents', 'doc_id')}),
j AS (SELECT sp.doc_id, sp.start, sp."end", t.start AS ts, t."end" AS te
      FROM sp LEFT JOIN t ON t.doc_id = sp.doc_id AND t.start < sp."end" AND sp.start < t."end")
SELECT doc_id, start, "end",
       CASE WHEN bool_or(ts = start) AND bool_or(te = "end") THEN start END AS strict_start,
       CASE WHEN bool_or(ts = start) AND bool_or(te = "end") THEN "end" END AS strict_end,
       min(ts) FILTER (WHERE ts >= start AND te <= "end") AS contract_start,
       max(te) FILTER (WHERE ts >= start AND te <= "end") AS contract_end,
       min(ts) AS expand_start, max(te) AS expand_end
FROM j GROUP BY doc_id, start, "end\"""",
)
def span_align(spark, sf):
    """Token alignment as a bucketed range join of span rows and token rows (linear, shuffles on
    ``(doc, bucket)``), then one aggregate per span for the three modes."""
    d = TK.with_tokens(QS.detect_frame(spark, sf, [QS.NONSPACE]), "text", "toks")
    spans = S.explode_rows(d, F.col("spans"), ["doc_id"]).select("doc_id", "s.start", "s.end")
    toks = S.explode_rows(d, F.col("toks"), ["doc_id"], "t").select("doc_id", "t.start", "t.end")
    j = SO.bucketed_overlap_join(spans, toks, ["doc_id"])
    inside = (F.col("ts") >= F.col("start")) & (F.col("te") <= F.col("end"))
    strict = F.max((F.col("ts") == F.col("start")).cast("int")) + F.max((F.col("te") == F.col("end")).cast("int")) == 2
    g = j.groupBy("doc_id", "start", "end").agg(
        strict.alias("ok"),
        F.min(F.when(inside, F.col("ts"))).alias("contract_start"), F.max(F.when(inside, F.col("te"))).alias("contract_end"),
        F.min("ts").alias("expand_start"), F.max("te").alias("expand_end"))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return g.select("doc_id", "start", "end", F.when(ok, F.col("start")).alias("strict_start"),
                    F.when(ok, F.col("end")).alias("strict_end"), "contract_start", "contract_end", "expand_start", "expand_end")


# Spans with whitespace on their edges: a space or newline, a capitalised word, maybe a space.
SPACED_WORD = ("W", r"[ \n][A-Z][a-z]+[ \n]?", False)
_SP_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@register(
    "whitespace_fix",
    "V6 A5",
    "documents",
    f"""WITH sp AS (SELECT doc_id, start, "end", surface FROM {QS.spans_sql([SPACED_WORD])}),
a AS (SELECT *, len(regexp_extract(surface, {sq('^' + _SP_CLASS + '*')})) AS lead FROM sp),
b AS (SELECT *, len(regexp_extract(substr(surface, lead + 1), {sq(_SP_CLASS + '*$')})) AS trail FROM a),
c AS (SELECT doc_id, start + lead AS ns, greatest(start + lead, "end" - trail) AS ne, start, "end" FROM b),
per AS (SELECT d.doc_id, count(c.doc_id) AS before, count(c.doc_id) FILTER (WHERE c.ne > c.ns) AS after,
               count(c.doc_id) FILTER (WHERE c.ns <> c.start OR c.ne <> c."end") AS changed
        FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT count(*) FILTER (WHERE changed > 0) AS docs_modified, sum(before) AS ents_before, sum(after) AS ents_after FROM per""",
)
def whitespace_fix(spark, sf):
    d = QS.detect_frame(spark, sf, [SPACED_WORD])
    d, blk = S.with_blocks(d, "text")
    d = d.withColumn("fixed", S.pinned(blk, F.transform("spans", lambda s: S.trim_whitespace(F.col("text"), s, F.col(blk)))))
    d = d.withColumn("changed", F.exists(F.arrays_zip("spans", "fixed"), lambda z: (z["spans"]["start"] != z["fixed"]["start"])
                                         | (z["spans"]["end"] != z["fixed"]["end"])))
    d = d.withColumn("kept", F.filter("fixed", lambda s: s["end"] > s["start"]))
    return d.agg(F.sum(F.col("changed").cast("int")).cast("long").alias("docs_modified"),
                 F.sum(F.size("spans")).cast("long").alias("ents_before"), F.sum(F.size("kept")).cast("long").alias("ents_after"))


_EMAIL_PRED = ("EMAIL", QS.P.PROFILE_REGEX_DEFAULTS["email"], True)


@register(
    "one_label_eval",
    "E7 S7 E1 E3",
    "documents",
    f"""WITH g AS (SELECT DISTINCT doc_id, start, "end" FROM {QS.spans_sql(QS.DETECT_SET)} WHERE label = 'EMAIL'),
p AS (SELECT DISTINCT doc_id, start, "end" FROM {QS.spans_sql([_EMAIL_PRED])}),
j AS (SELECT g.doc_id IS NOT NULL AS in_g, p.doc_id IS NOT NULL AS in_p FROM g FULL OUTER JOIN p
      ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end"),
c AS (SELECT count(*) FILTER (WHERE in_g AND in_p) AS tp, count(*) FILTER (WHERE in_p AND NOT in_g) AS fp,
             count(*) FILTER (WHERE in_g AND NOT in_p) AS fn FROM j)
SELECT (SELECT count(*) FROM documents) AS docs, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c""",
)
def one_label_eval(spark, sf):
    from ..operators import evaluate as EV

    d = annotated(spark, sf).withColumn("gold", C.parse_ann(F.col("ann"), F.col("text"), only_label="EMAIL"))
    d = S.with_detector_spans(d, "text", [QS._java(_EMAIL_PRED)], "pred")
    d = d.withColumn("c", EV.strict_counts(F.col("gold"), F.col("pred")))
    s = d.agg(F.count(F.lit(1)).alias("docs"), F.sum("c.tp").cast("long").alias("tp"),
              F.sum("c.fp").cast("long").alias("fp"), F.sum("c.fn").cast("long").alias("fn"))
    p, r, _ = EV.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("docs", "tp", "fp", "fn", p.alias("p"), r.alias("r"))


@register(
    "label_list",
    "A7 T9",
    "documents",
    f"""WITH l AS (SELECT DISTINCT label FROM {QS.spans_sql(QS.DETECT_SET)}),
k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM l)
SELECT 'O' AS tag, 0 AS id
UNION ALL SELECT 'B-' || label, CAST(2 * k + 1 AS INTEGER) FROM k
UNION ALL SELECT 'I-' || label, CAST(2 * k + 2 AS INTEGER) FROM k""",
)
def label_list(spark, sf):
    return TK.bio_label_list(parsed_rows(spark, sf).select("label"))


@register(
    "rejects_no_ann",
    "J2 J1 (documents without annotations)",
    "documents",
    f"""WITH n AS (SELECT doc_id, count(*) AS n FROM {QS.spans_sql(QS.DETECT_SET)} GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN 'NO_ANN' ELSE 'OK' END AS status, coalesce(n.n, 0) AS n_spans
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
)
def rejects_no_ann(spark, sf):
    d = annotated(spark, sf).withColumn("n_spans", F.size(C.parse_ann(F.col("ann"), F.col("text"))).cast("long"))
    return d.select("doc_id", F.when(F.col("n_spans") > 0, "OK").otherwise("NO_ANN").alias("status"), "n_spans")


#: Annotation lines of each kind: several annotations without tabs, proper, a note, a relation, one that does not parse, a
#: tab in a line with several, and one that does not start with T.
_D1, _D2 = QN._pick(QN.DRUGS, "o_orderkey"), QN._pick(QN.DRUGS, "o_custkey")
_LINES = [
    (f"concat('T1 FARMACO 7 18 ', {_D1}, ' 10 mg T2 FARMACO 21 35  ', {_D2}, ' T3 FARMACO 40 44 x ')",
     f"concat('T1\tFARMACO 7 18\t', {_D1}, ' 10 mg\nT2\tFARMACO 21 35\t', {_D2}, '\nT3\tFARMACO 40 44\tx')", "true"),
    (f"concat('T1\tFARMACO 0 5\t', {_D1})", None, "NULL"),
    ("concat('#1\tAnnotatorNotes T1\tsee T1 FARMACO 0 3 ', CAST(o_orderkey AS STRING))", None, "NULL"),
    (f"concat('R1 Rel T1 FARMACO 7 18 ', {_D1})", None, "NULL"),
    (f"concat('T9 sin forma ', {_D1})", None, "false"),
    (f"concat('T1 FARMACO 7 18 ', {_D1}, '\tT2 FARMACO 21 35 ', {_D2})", None, "NULL"),
    (f"concat(' T1 FARMACO 7 18 ', {_D1})", None, "NULL"),
    (f"concat('T4 OTRO 1 2 a T5 FARMACO 3 9 ', {_D2})", f"concat('T5\tFARMACO 3 9\t', {_D2})", "true"),
]
_LINE = "CASE " + " ".join(f"WHEN o_orderkey % {len(_LINES)} = {i} THEN {x[0]}" for i, x in enumerate(_LINES)) + " END"


@register(
    "fix_ann_lines",
    "T10 (several annotations on a line without tabs)",
    "orders",
    "SELECT o_orderkey, CASE " + " ".join(f"WHEN o_orderkey % {len(_LINES)} = {i} THEN {x[1] or x[0]}" for i, x in enumerate(_LINES)) + " END AS lines, CASE "
    + " ".join(f"WHEN o_orderkey % {len(_LINES)} = {i} THEN CAST({x[2]} AS BOOLEAN)" for i, x in enumerate(_LINES)) + " END AS parsed FROM orders",
)
def fix_ann_lines(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", C.fix_ann_line(F.expr(_LINE)).alias("f"))
    return o.select("o_orderkey", F.array_join("f.lines", "\n").alias("lines"), "f.parsed")


_CITY = QN._pick(QN.TOWNS, "c_custkey")
_PERSON_TEXT = f"concat(c_name, ' vive en ', {_CITY}, '.  ')"
_END = f"(27 + length({_CITY}))"
#: Second annotation line of a customer's text, by kind, and the rejects that it makes: label, start, end, reason.
_ANNOTATED = [
    (f"concat('T2\tTERRITORIO 27 ', CAST({_END} AS STRING), '\t', {_CITY})", None),
    (f"concat('T2\tTERRITORIO 26 ', CAST({_END} AS STRING), '\t', {_CITY})", ("'TERRITORIO'", "26", _END, "isspace-edge")),
    (f"concat('T2\tTERRITORIO 27 ', CAST({_END} + 1 AS STRING), '\t', {_CITY})", ("'TERRITORIO'", "27", f"({_END} + 1)", "space/punct-edge")),
    ("'T2\tTERRITORIO 27 999\tx'", ("'TERRITORIO'", "27", "999", "out-of-range")),
    ("'T2 TERRITORIO 27 31 sin tabulador'", ("NULL", "NULL", "NULL", "malformed")),
    ("'R1\tRel Arg1:T1 Arg2:T2'", None),
    (f"concat('T2\tTERRITORIO 0 8; 27 ', CAST({_END} AS STRING), '\tx')", None),
]
_ANN = "concat('T1\tNOMBRE 0 18\t', c_name, '\n', " + "CASE " + " ".join(f"WHEN c_custkey % {len(_ANNOTATED)} = {i} THEN {x}" for i, (x, _) in enumerate(_ANNOTATED)) + " END)"


def _annotated(spark, sf):
    """A stand-off corpus of one short text a customer, with the faults that annotation files have."""
    c = spread(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return c.select(F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'dev' ELSE 'train' END").alias("split"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("stem"),
                    F.expr(_PERSON_TEXT).alias("text"), F.expr(_ANN).alias("ann"))


def _rejects_sql():
    parts = []
    for i, (_, bad) in enumerate(_ANNOTATED):
        if bad:
            label, a, b, reason = bad
            frag = f"substr({_PERSON_TEXT}, {a} + 1, {b} - {a})" if reason.endswith("edge") else "''"
            edge = (f"printf('U+%04X', unicode({frag}[1])), printf('U+%04X', unicode({frag}[-1]))", f"substr({_PERSON_TEXT}, greatest({a} - 30, 0) + 1, {b} + 30 - greatest({a} - 30, 0))") if reason.endswith("edge") else ("'', ''", "''")
            parts.append(f"SELECT CASE WHEN c_custkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split, concat('c', c_custkey, '.ann:2') AS file, coalesce({label}, '') AS label, "
                         f"coalesce(CAST({a} AS VARCHAR), '') AS start, coalesce(CAST({b} AS VARCHAR), '') AS \"end\", '{reason}' AS reason, {edge[0]}, {frag} AS frag, {edge[1]} AS context "
                         f"FROM customer WHERE c_custkey % {len(_ANNOTATED)} = {i}")
    names = "split, file, label, start, \"end\", reason, first, last, frag, context"
    return f"WITH r({names}) AS ({' UNION ALL '.join(parts)}) SELECT * FROM r"


@register("corpus_rejects", "S13 V8 S5 B2S-report (rejects with file, line and reason, as the TSV says)", "customer", _rejects_sql())
def corpus_rejects(spark, sf):
    """One stored scan of the corpus gives good spans and rejects; the rejects are written as the report and read back."""
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/velado-corpus/{uuid.uuid4().hex}"
    C.checked_lines(_annotated(spark, sf)).write.parquet(f"{home}/lines")
    lines = spark.read.parquet(f"{home}/lines")
    SK.write_rejects(lines.where("reason is not null"), f"{home}/rejects")
    schema = ", ".join(f"`{c}` string" for c in SK.REJECT_COLUMNS)
    found = spark.read.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema(schema).csv(f"{home}/rejects")
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) for c in SK.REJECT_COLUMNS])


@register(
    "corpus_spans",
    "S5 V8 A4 (good spans of the same scan, by label and split)",
    "customer",
    f"""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split, label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT c_custkey, 'NOMBRE' AS label, 1 AS n, 18 AS chars FROM customer
  UNION ALL SELECT c_custkey, 'TERRITORIO', CASE WHEN c_custkey % {len(_ANNOTATED)} = 0 THEN 1 ELSE 2 END,
                   length({_CITY}) + CASE WHEN c_custkey % {len(_ANNOTATED)} = 0 THEN 0 ELSE 8 END FROM customer WHERE c_custkey % {len(_ANNOTATED)} IN (0, 6)) GROUP BY 1, 2""",
)
def corpus_spans(spark, sf):
    good = C.checked_lines(_annotated(spark, sf)).where("reason is null")
    return good.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))
