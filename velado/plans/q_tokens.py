"""Token queries: features and context (T1-T4, W1), char n-grams (T2), BIO tags (T8), chunks (W3),
weak span labels (T6, T5) with the balanced sample (W5, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import evaluate as EV
from ..operators import lexicon as LX
from ..operators import tokens as TK
from ..operators import weak as WK
from . import q_spans as QS
from .registry import REGISTRY, register, table
from .sqlpat import re2, sq

TOKEN_RE2 = sq(re2(P.TOKEN_PATTERN))


def tokens_sql(source: str, keys: str, text: str = "text") -> str:
    """DuckDB tokens with code-point offsets: ``keys..., i (0-based), tok, start, end``."""
    part = ", ".join(k.strip() for k in keys.split(","))
    return f"""(SELECT {keys}, i - 1 AS i, m[i] AS tok,
        CAST(sum(len(g[i]) + len(m[i])) OVER (PARTITION BY {part} ORDER BY i ROWS UNBOUNDED PRECEDING) - len(m[i]) AS INTEGER) AS start,
        CAST(sum(len(g[i]) + len(m[i])) OVER (PARTITION BY {part} ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) AS "end"
      FROM (SELECT {keys}, m, g, generate_subscripts(m, 1) AS i
            FROM (SELECT {keys}, regexp_extract_all(coalesce({text}, ''), {TOKEN_RE2}) AS m,
                         string_split_regex(coalesce({text}, ''), {TOKEN_RE2}) AS g FROM {source})))"""


_UNITS_SQL = "[" + ", ".join(sq(u) for u in P.FEATURE_UNITS) + "]"
_LEX_SQL = "[" + ", ".join(sq(u) for u in sorted(set(P.BUILTIN_DRUGS))) + "]"

_CTX_SQL = f"""WITH t AS {tokens_sql('conversations', 'conv_id, turn')},
c AS (SELECT *, coalesce(lower(lag(tok, 1) OVER w), '') AS prev1, coalesce(lower(lead(tok, 1) OVER w), '') AS next1,
             coalesce(lower(lag(tok, 2) OVER w), '') AS prev2, coalesce(lower(lead(tok, 2) OVER w), '') AS next2
      FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))"""


@register(
    "token_features",
    "T1 T3 T4 W1 (in-row)",
    "conversations",
    _CTX_SQL
    + f"""
SELECT conv_id, turn, i, tok, start, "end", prev1, next1, prev2, next2,
  CAST(list_contains({_UNITS_SQL}, next1) OR list_contains({_UNITS_SQL}, prev1)
       OR list_contains({_UNITS_SQL}, next2) OR list_contains({_UNITS_SQL}, prev2) AS INTEGER) AS ctx_has_unit,
  CAST(regexp_matches(next1, '[0-9]') OR regexp_matches(prev1, '[0-9]') AS INTEGER) AS ctx_has_number,
  CAST(regexp_matches(substr(tok, 1, 1), '^\\p{{Lu}}') AS INTEGER) AS is_capitalized,
  CAST(list_contains({_LEX_SQL}, lower(tok)) AS INTEGER) AS in_lex
FROM c""",
)
def token_features(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    d = TK.with_tokens(conv, "text", "toks").withColumn("lex", F.array(*[F.lit(x) for x in sorted(set(P.BUILTIN_DRUGS))]))
    d = d.withColumn("f", TK.context_features("toks", "lex"))
    return S.explode_rows(d, F.col("f"), ["conv_id", "turn"]).select("conv_id", "turn", "s.*")


@register(
    "context_window",
    "W1 (row form, lag/lead)",
    "conversations",
    _CTX_SQL + "\nSELECT conv_id, turn, i, tok, prev1, next1, prev2, next2 FROM c",
)
def context_window(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    d = TK.with_tokens(conv, "text", "toks")
    rows = S.explode_rows(d, F.col("toks"), ["conv_id", "turn"]).select("conv_id", "turn", "s.i", "s.tok")
    return TK.context_rows(rows, ["conv_id", "turn"])


@register(
    "char_ngrams",
    "T2",
    "conversations",
    f"""WITH t AS {tokens_sql('conversations', 'conv_id, turn')},
g AS (SELECT DISTINCT conv_id, turn, i, k, substr(lower(tok), j, k) AS gram
      FROM t, (VALUES (3), (4), (5)) ks(k), range(1, 100000) r(j)
      WHERE j <= len(tok) - k + 1)
SELECT 'char' || k || '=' || gram AS feature, count(*) AS n_tokens FROM g GROUP BY 1""",
)
def char_ngrams(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    d = TK.with_tokens(conv, "text", "toks")
    rows = S.explode_rows(d, F.col("toks"), [], "t")
    grams = rows.select(F.explode(TK.char_ngrams(F.col("t.tok"))).alias("feature"))
    return grams.groupBy("feature").agg(F.count(F.lit(1)).alias("n_tokens"))


# Gold for BIO/chunks: hard-regex spans merged into PHI islands.
def _gold(spark, sf):
    d = QS.detect_frame(spark, sf, QS.DETECT_SET)
    return d.withColumn("gold", S.merge_spans(F.col("spans"), label="PHI")).drop("spans")


_MERGED_GOLD_SQL = f"""sp AS (SELECT doc_id, start, max("end") AS "end" FROM {QS.spans_sql(QS.DETECT_SET)} GROUP BY doc_id, start),
w AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
isl AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM w),
gold AS (SELECT doc_id, min(start) AS s, max("end") AS e FROM isl GROUP BY doc_id, island)"""


@register(
    "bio_tags",
    "T8 T9 J4",
    "documents",
    f"""WITH t AS {tokens_sql('documents', 'doc_id')}, {_MERGED_GOLD_SQL},
hit AS (SELECT t.doc_id, t.i, g.s FROM t JOIN gold g ON t.doc_id = g.doc_id AND t.start < g.e AND g.s < t."end"),
tag AS (SELECT h.doc_id, CASE WHEN p.i IS NULL THEN 'B-PHI' ELSE 'I-PHI' END AS tag
        FROM hit h LEFT JOIN hit p ON p.doc_id = h.doc_id AND p.i = h.i - 1 AND p.s = h.s
        UNION ALL
        SELECT t.doc_id, 'O' FROM t ANTI JOIN hit h ON h.doc_id = t.doc_id AND h.i = t.i)
SELECT doc_id, tag, count(*) AS n FROM tag GROUP BY doc_id, tag""",
)
def bio_tags(spark, sf):
    d = TK.with_tokens(_gold(spark, sf), "text", "toks")
    d = TK.with_bio_tags(d, "toks", "gold", "tags")
    # Count tags inside the row (few distinct tags per document): no per-token rows, no shuffle.
    counts = S.pinned("tags", F.transform(F.array_distinct(F.col("tags")), lambda t: F.struct(
        t.alias("tag"), F.size(F.filter(F.col("tags"), lambda x: x == t)).cast("long").alias("n"))))
    return S.explode_rows(d.withColumn("cnt", counts), F.col("cnt"), ["doc_id"]).select("doc_id", "s.tag", "s.n")


MAX_LEN, STRIDE = 256, 128


@register(
    "chunks",
    "W3",
    "documents",
    f"""WITH t AS {tokens_sql('documents', 'doc_id')},
n AS (SELECT d.doc_id, count(t.i) AS n FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id),
c AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - {MAX_LEN}) / {MAX_LEN - STRIDE}) AS BIGINT)) + 1)) AS chunk FROM n)
SELECT c.doc_id, CAST(c.chunk AS INTEGER) AS chunk, CAST(c.chunk * {MAX_LEN - STRIDE} AS INTEGER) AS first_tok,
       CAST(least({MAX_LEN}, c.n - c.chunk * {MAX_LEN - STRIDE}) AS INTEGER) AS n_tok,
       min(t.start) AS char_start, max(t."end") AS char_end
FROM c LEFT JOIN t ON t.doc_id = c.doc_id AND t.i >= c.chunk * {MAX_LEN - STRIDE}
                   AND t.i < c.chunk * {MAX_LEN - STRIDE} + {MAX_LEN}
GROUP BY c.doc_id, c.chunk, c.n""",
)
def chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    d = TK.with_tokens(docs, "text", "toks").withColumn("starts", TK.chunk_starts(F.size("toks"), MAX_LEN, STRIDE))

    def chunk(st, k):
        part = F.slice(F.col("toks"), st + 1, MAX_LEN)
        return F.struct(
            k.alias("chunk"), st.alias("first_tok"), F.size(part).alias("n_tok"),
            F.get(part, 0)["start"].alias("char_start"), F.try_element_at(part, F.lit(-1))["end"].alias("char_end"),
        )

    d = d.withColumn("ch", S.pinned("toks", F.transform(F.col("starts"), chunk)))
    return S.explode_rows(d, F.col("ch"), ["doc_id"]).select("doc_id", "s.*")


#: A number tagger that sees one chunk at a time: a token that starts with a digit, I after such a token of the same chunk.
_CHUNK_TAGS_SQL = f"""t AS {tokens_sql('documents', 'doc_id')},
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - {MAX_LEN}) / {MAX_LEN - STRIDE}) AS BIGINT)) + 1)) AS chunk FROM n),
x AS (SELECT t.*, chunk, i - chunk * {MAX_LEN - STRIDE} AS j, least({MAX_LEN}, n - chunk * {MAX_LEN - STRIDE}) AS len FROM t JOIN c ON c.doc_id = t.doc_id
      AND i >= chunk * {MAX_LEN - STRIDE} AND i < chunk * {MAX_LEN - STRIDE} + {MAX_LEN}),
y AS (SELECT *, regexp_matches(tok, '^[0-9]') AS num, lag(regexp_matches(tok, '^[0-9]')) OVER (PARTITION BY doc_id, chunk ORDER BY i) AS before FROM x),
z AS (SELECT *, CASE WHEN NOT num THEN 'O' WHEN before THEN 'I-NUM' ELSE 'B-NUM' END AS tag,
             row_number() OVER (PARTITION BY doc_id, i ORDER BY least(j, len - 1 - j) DESC, chunk) AS pick FROM y),
s AS (SELECT doc_id, i, tok, start, "end", chunk, tag FROM z WHERE pick = 1)"""


def _stitched(spark, sf):
    """Tokens of the documents with the tags of a tagger that ran over overlapping chunks, stitched together."""
    d = TK.with_tokens(table(spark, sf, "documents").select("doc_id", "text"), "text", "toks")
    d = d.withColumn("starts", TK.chunk_starts(F.size("toks"), MAX_LEN, STRIDE))
    d = d.withColumn("num", S.pinned("toks", F.transform("toks", lambda t: t["tok"].rlike("^[0-9]"))))

    def tags(start, length):
        own = F.slice("num", start + 1, length)
        return F.transform(own, lambda x, j: F.when(~x, "O").when((j > 0) & F.get(F.col("num"), start + j - 1), "I-NUM").otherwise("B-NUM"))

    d = d.withColumn("chunked", S.pinned("num", TK.chunk_tags(F.size("toks"), F.col("starts"), tags, MAX_LEN)))
    return d.withColumn("tags", S.pinned("chunked", TK.stitch_chunks(F.size("toks"), F.col("chunked"), MAX_LEN, STRIDE)))


@register(
    "stitched_tags",
    "W3 (each token from the chunk with most context)",
    "documents",
    f"""WITH {_CHUNK_TAGS_SQL}
SELECT doc_id, tag, count(*) AS n, CAST(sum(i) AS BIGINT) AS sum_i FROM s GROUP BY doc_id, tag""",
)
def stitched_tags(spark, sf):
    d = _stitched(spark, sf)
    at = S.pinned("tags", F.transform(F.array_distinct("tags"), lambda t: F.struct(
        t.alias("tag"), F.filter(S.seq0(F.size("tags")), lambda i: F.get(F.col("tags"), i) == t).alias("at"))))
    rows = S.explode_rows(d.withColumn("by", at), F.col("by"), ["doc_id"]).select("doc_id", "s.*")
    total = F.aggregate("at", F.lit(0).cast("long"), lambda a, i: a + i)
    return rows.select("doc_id", "tag", F.size("at").cast("long").alias("n"), total.alias("sum_i"))


_ISLANDS = """SELECT doc_id, min(start) AS a, max("end") AS b FROM (
  SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, {tag} = 'B-NUM' OR coalesce(lag({tag}) OVER (PARTITION BY doc_id ORDER BY i), 'O') = 'O' AS fresh FROM live) WHERE {tag} <> 'O') GROUP BY doc_id, island"""


@register(
    "chunk_eval",
    "E8 W3 (entity P/R/F1 of stitched tags, positions marked -100 ignored)",
    "documents",
    f"""WITH {_CHUNK_TAGS_SQL},
m AS (SELECT *, regexp_matches(tok, '[0-9]') AS digit, lag(regexp_matches(tok, '[0-9]')) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s),
live AS (SELECT *, CASE WHEN NOT digit THEN 'O' WHEN before THEN 'I-NUM' ELSE 'B-NUM' END AS gold FROM m WHERE length(tok) > 1),
g AS ({_ISLANDS.format(tag="gold")}), p AS ({_ISLANDS.format(tag="tag")}),
k AS (SELECT (SELECT count(*) FROM g JOIN p USING (doc_id, a, b)) AS tp, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM g) AS n_gold)
SELECT tp, n_pred - tp AS fp, n_gold - tp AS fn, tp / n_pred AS p, tp / n_gold AS r, 2 * tp / (n_pred + n_gold) AS f1 FROM k""",
)
def chunk_eval(spark, sf):
    d = _stitched(spark, sf)
    digit = S.pinned("toks", F.transform("toks", lambda t: t["tok"].rlike("[0-9]")))
    d = d.withColumn("digit", digit)
    gold = F.transform("toks", lambda t, i: F.when(F.length(t["tok"]) <= 1, EV.IGNORED).when(~F.get(F.col("digit"), i), "O").when(
        (i > 0) & F.get(F.col("digit"), i - 1), "I-NUM").otherwise("B-NUM"))
    d = EV.sequence_counts(d.withColumn("gold", S.pinned("digit", gold)), "toks", "gold", "tags", "c")
    c = d.agg(*(F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn")))
    p, r, f1 = EV.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("p"), r.alias("r"), f1.alias("f1"))


@register(
    "label_ids",
    "T9 (tags to ids, unknown to O)",
    "documents",
    f"""SELECT doc_id, CASE WHEN tag = 'B-PHI' THEN 1 ELSE 0 END AS id, CAST(sum(n) AS BIGINT) AS n FROM ({{tags}}) GROUP BY ALL""".replace("{tags}", REGISTRY["bio_tags"].sql),
)
def label_ids(spark, sf):
    """BIO tags as ids of a label list that lacks the inside tag, which counts as ``O``."""
    d = TK.with_bio_tags(TK.with_tokens(_gold(spark, sf), "text", "toks"), "toks", "gold", "tags")
    d = d.withColumn("ids", S.pinned("tags", TK.label_ids(F.col("tags"), ["O", "B-PHI"])))
    counts = F.transform(F.array_distinct("ids"), lambda x: F.struct(x.alias("id"), F.size(F.filter("ids", lambda y: y == x)).cast("long").alias("n")))
    return S.explode_rows(d.withColumn("cnt", S.pinned("ids", counts)), F.col("cnt"), ["doc_id"]).select("doc_id", "s.id", "s.n")


@register(
    "weak_span_counts",
    "T6 T5 J3 V15 A6",
    "documents",
    f"""WITH t AS {tokens_sql('documents', 'doc_id')},
c AS (SELECT t.*, lower(tok) AS lw,
             lower(substr(d.text, greatest(t.start - 20, 0) + 1, t.start - greatest(t.start - 20, 0)) || ' ' ||
                   substr(d.text, t."end" + 1, 20)) AS ctx
      FROM t JOIN documents d USING (doc_id))
SELECT CASE WHEN list_contains({_LEX_SQL}, lw) THEN 'DRUG'
            WHEN list_contains([{', '.join(sq(x) for x in sorted(set(P.COMMON_GIVEN_NAMES)))}], lw) THEN 'SENSITIVE'
            WHEN regexp_matches(ctx, {sq(WK.DOSE_CTX_RE2)}) THEN 'DRUG' ELSE 'OTHER' END AS label,
       count(*) AS n
FROM c GROUP BY 1""",
)
def weak_span_counts(spark, sf):
    arr = WK.weak_span_array(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", labels_only=True)
    return WK.label_counts_inrow(arr, "doc_id")


def _balanced_sql():
    names = "[" + ", ".join(sq(x) for x in sorted(set(P.COMMON_GIVEN_NAMES))) + "]"
    key = "concat_ws('|', {seed}, doc_id, i, \"left\", span, \"right\")"
    return f"""WITH t AS {tokens_sql('documents', 'doc_id')},
c AS (SELECT t.doc_id, t.i, t.tok AS span,
             substr(d.text, greatest(t.start - 50, 0) + 1, t.start - greatest(t.start - 50, 0)) AS "left",
             substr(d.text, t."end" + 1, 50) AS "right",
             lower(substr(d.text, greatest(t.start - 20, 0) + 1, t.start - greatest(t.start - 20, 0)) || ' ' ||
                   substr(d.text, t."end" + 1, 20)) AS ctx, lower(t.tok) AS lw
      FROM t JOIN documents d USING (doc_id)),
l AS (SELECT doc_id, i, "left", span, "right",
             CASE WHEN list_contains({_LEX_SQL}, lw) THEN 'DRUG' WHEN list_contains({names}, lw) THEN 'SENSITIVE'
                  WHEN regexp_matches(ctx, {sq(WK.DOSE_CTX_RE2)}) THEN 'DRUG' ELSE 'OTHER' END AS label FROM c),
cap AS (SELECT least(5000, CAST(floor(count(*) * 0.5) AS BIGINT)) AS k FROM l),
o AS (SELECT l.*, row_number() OVER (ORDER BY md5({key.format(seed="'42'")})) AS rn FROM l WHERE label = 'OTHER'),
keep AS (SELECT doc_id, i, "left", span, "right", label FROM l WHERE label <> 'OTHER'
         UNION ALL SELECT doc_id, i, "left", span, "right", label FROM o, cap WHERE rn <= cap.k)
SELECT *, md5({key.format(seed="'43'")}) AS order_key FROM keep"""


@register("balanced_sample", "W5 W6 T6", "documents", _balanced_sql())
def balanced_sample(spark, sf):
    return WK.balanced_spans(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", seed=42)


@register(
    "stratified_tokens",
    "W7 T5 (exact 85/15 split within each label)",
    "documents",
    f"""WITH l AS (SELECT doc_id, i, CASE WHEN list_contains({_LEX_SQL}, lower(tok)) THEN 'DRUG' WHEN regexp_matches(tok, '^[0-9]') THEN 'NUMBER' ELSE 'OTHER' END AS label
           FROM {tokens_sql('documents', 'doc_id')}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', doc_id, i)), doc_id, i) AS nth, count(*) OVER (PARTITION BY label) AS n FROM l)
SELECT label, CASE WHEN nth <= floor(0.15 * n + 0.5) THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(i) AS BIGINT) AS sum_i, CAST(sum(doc_id) AS BIGINT) AS sum_doc
FROM r GROUP BY ALL""",
)
def stratified_tokens(spark, sf):
    d = TK.with_tokens(table(spark, sf, "documents").select("doc_id", "text"), "text", "toks")
    rows = S.explode_rows(d, F.col("toks"), ["doc_id"]).select("doc_id", "s.i", "s.tok")
    rows = WK.weak_token_labels(rows, "tok", LX.from_terms(spark, P.BUILTIN_DRUGS))
    number = (F.col("label") == "OTHER") & F.col("tok").rlike("^[0-9]")
    rows = rows.select("doc_id", "i", F.when(number, "NUMBER").otherwise(F.col("label")).alias("label"))
    out = WK.stratified_split(rows, "label", ["doc_id", "i"])
    return out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("i").cast("long").alias("sum_i"), F.sum("doc_id").alias("sum_doc"))
