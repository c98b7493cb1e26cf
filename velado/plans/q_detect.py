"""Detection queries: medication protection with masking (D14, M6, M7, M8), gazetteer masking
(D5, S8), large-lexicon token join (J3), label-policy predicates (F2p-F6p, F9p, F10p)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import lexicon as LX
from ..operators import mask as M
from ..operators import policy as PO
from ..operators import spanops as SO
from ..operators import tokens as TK
from ..profile import default_profile
from . import q_spans as QS
from .registry import register, table
from .sqlpat import profile_steps, sq

STEP_NAMES = [s[0] for s in profile_steps()]


@register("protected_mask", "M8 M6 M7 D14 D8 D10 D11 D13 N1", "documents")
def protected_mask(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    prof = default_profile(drug_lexicon_extra=P.BUILTIN_DRUGS)
    d = M.mask_text(docs, "text", prof, out="masked", counts="c", protect=True)
    names = STEP_NAMES + ["heur"]
    return d.select("doc_id", "masked", *[F.col(f"c.{n}").alias(f"n_{n}") for n in names],
                    F.col("c.protected").alias("n_protected"))


@register("protected_mask_wide", "M8 D14 (wide rules: D12, hyphen/sign lexicon)", "documents")
def protected_mask_wide(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    prof = default_profile(drug_lexicon_extra=P.BUILTIN_DRUGS, wide_drug_rules=True)
    d = M.mask_text(docs, "text", prof, out="masked", counts="c", protect=True)
    return d.select("doc_id", "masked", F.col("c.protected").alias("n_protected"))


# Gazetteer derived from the data: all title-case words of the benchmark passages (which are embedded
# in the documents).
GAZ_WORD = "[A-Z][a-z]{5,}"


def gazetteer_terms(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.explode(F.regexp_extract_all("text", F.lit(GAZ_WORD), 0)).alias("term")).distinct()


# Oracle: Unicode word runs (RE2 has only an ASCII \b); a run equal to a term, ignoring case, is a match.
_W = "[\\p{L}\\p{N}_]+"
_GAZ_SQL = f"""WITH w AS (SELECT unnest(regexp_extract_all(text, {sq(GAZ_WORD)})) AS term FROM benchmark),
lx AS (SELECT DISTINCT lower(term) AS term FROM w),
d AS (SELECT doc_id, text, regexp_extract_all(text, {sq(_W)}) AS m, string_split_regex(text, {sq(_W)}) AS g FROM documents),
t AS (SELECT doc_id, unnest(m) AS word FROM d),
h AS (SELECT t.doc_id, list(DISTINCT lx.term) AS terms, count(*) AS n FROM t JOIN lx ON lx.term = lower(t.word) GROUP BY t.doc_id)
SELECT d.doc_id,
       CASE WHEN text IS NULL THEN NULL WHEN h.n IS NULL THEN text ELSE
       array_to_string(list_transform(range(1, len(m) + 1),
           lambda i: g[i] || CASE WHEN list_contains(h.terms, lower(m[i])) THEN '[LOC]' ELSE m[i] END), '') || g[len(m) + 1] END AS masked,
       coalesce(h.n, 0) AS n_loc
FROM d LEFT JOIN h ON h.doc_id = d.doc_id"""


@register("gazetteer_mask", "D5 S8 O2", "documents benchmark", _GAZ_SQL)
def gazetteer_mask(spark, sf):
    """Every place name of a lexicon of any size, by the word-run join, longest first (V10), masked (M1)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = LX.lexicon_spans(docs, "text", "doc_id", gazetteer_terms(spark, sf))
    d = docs.join(found, "doc_id", "left").withColumn("spans", S.select_longest(F.col("spans")))
    d, blk = S.with_blocks(d, "text")
    masked = S.pinned(blk, S.replace_spans(F.col("text"), F.col("spans"), "[LOC]", blocks=F.col(blk)))
    return d.select("doc_id", masked.alias("masked"), F.size("spans").cast("long").alias("n_loc"))


_LEX_WORD = r"[A-Za-z]{4,}"


@register(
    "lexicon_tokens",
    "J3 T5 S8 (token x lexicon join)",
    "documents benchmark",
    f"""WITH lex AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, {sq(_LEX_WORD)}))) AS term FROM benchmark),
t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+([\\-.][\\p{{L}}\\p{{N}}_]+)*'))) AS lw FROM documents)
SELECT d.doc_id, count(lex.term) AS n_hits, count(DISTINCT lex.term) AS n_terms
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN lex ON lex.term = t.lw GROUP BY d.doc_id""",
)
def lexicon_tokens(spark, sf):
    lex = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_LEX_WORD), 0)).alias("w")) \
        .select(F.lower("w").alias("term")).dropDuplicates(["term"])
    docs = table(spark, sf, "documents").select("doc_id", "text")
    toks = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TK.TOKEN_RE), F.lit(0))
    rows = S.explode_rows(docs.select("doc_id", toks.alias("toks")), F.col("toks"), ["doc_id"], "tok")
    # The lexicon (broadcast if it counts as small) drops most tokens before anything is shuffled; then one row per
    # (document, term) and one per document, which share the shuffle on the document.
    hit = LX.tag_tokens(rows, "tok", lex.withColumn("hit", F.col("term")), how="inner").repartition("doc_id")
    occ = hit.groupBy("doc_id", "hit").agg(F.count(F.lit(1)).alias("occ"))
    per = occ.groupBy("doc_id").agg(F.sum("occ").alias("n_hits"), F.count(F.lit(1)).alias("n_terms"))
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


ENTITY_LIKE = ("ENT", r"[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,2}", False)


def _policy_sql():
    suf = "(" + "|".join(P.POLICY_DRUG_SUFFIXES) + r")(\s|$)"
    kw = "(" + "|".join(P.HOSPITAL_KEYWORDS) + ")"
    safe = "[" + ", ".join(sq(x) for x in P.SAFE_ORG_TERMS) + "]"
    given = "[" + ", ".join(sq(x) for x in P.COMMON_GIVEN_NAMES) + "]"
    return f"""WITH sp AS (SELECT surface AS t, trim(surface) AS s,
                  CASE len(string_split_regex(trim(surface), '\\s+')) WHEN 1 THEN 'ORG' WHEN 2 THEN 'PER' ELSE 'LOC' END AS label
            FROM {QS.spans_sql([ENTITY_LIKE])}),
f AS (SELECT label,
        length(lower(s)) > 2 AND regexp_matches(lower(s), {sq(suf)}) AS drug,
        s = upper(s) AND s <> lower(s) AND length(s) BETWEEN 3 AND 8 AS acronym,
        regexp_matches(lower(s), {sq(kw)}) OR len(string_split_regex(s, '\\s+')) >= 3 AS health_org,
        list_contains({safe}, lower(s)) AS safe,
        len(string_split_regex(s, '\\s+')) >= 2 OR list_contains({given}, lower(s)) AS many_or_given, s FROM sp),
g AS (SELECT *, s <> '' AND NOT acronym AND NOT drug AND many_or_given AS plausible FROM f)
SELECT label, drug, acronym, health_org, safe, plausible,
       (label = 'PER') OR (label = 'ORG' AND NOT safe AND NOT drug AND health_org) OR label IN ('LOC', 'GPE', 'FAC') AS keep_precision,
       (label = 'PER' AND plausible AND NOT drug) OR (label IN ('GPE', 'LOC') AND NOT safe AND NOT drug) AS keep_conservative,
       count(*) AS n
FROM g GROUP BY ALL"""


@register("policy_flags", "F2p F3p F4p F5p F6p F9p F10p F1p", "documents", _policy_sql())
def policy_flags(spark, sf):
    d = QS.detect_frame(spark, sf, [ENTITY_LIKE])
    rows = SO.explode_spans(d, "spans", ["doc_id"], text="text")
    t = F.col("surface")
    n_words = F.size(F.split(F.trim(t), r"\s+"))
    label = F.when(n_words == 1, "ORG").when(n_words == 2, "PER").otherwise("LOC")
    rows = rows.withColumn("label", label)
    return rows.groupBy(
        "label",
        PO.is_drug_name(t).alias("drug"), PO.is_generic_acronym(t).alias("acronym"),
        PO.looks_like_health_org(t).alias("health_org"), PO.is_safe_term(t).alias("safe"),
        PO.is_plausible_person(t).alias("plausible"),
        PO.precision_first(F.col("label"), t).alias("keep_precision"),
        PO.conservative(F.col("label"), t).alias("keep_conservative"),
    ).agg(F.count(F.lit(1)).alias("n"))


# Phrase lexicon derived from the data: all runs of two and three lower-case words of the benchmark
# passages.
PHRASES = ["[a-z]{4,} [a-z]{4,}", "[a-z]{3,} [a-z]{3,} [a-z]{3,}"]


@register(
    "phrase_matches",
    "D9 (word-run x phrase lexicon join, several lengths)",
    "documents benchmark",
    f"""WITH ph AS (SELECT unnest(regexp_extract_all(text, {sq(PHRASES[0])})) AS phrase FROM benchmark
       UNION SELECT unnest(regexp_extract_all(text, {sq(PHRASES[1])})) FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(text, {sq(_W)}) AS m, string_split_regex(text, {sq(_W)}) AS g FROM documents),
i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM d),
r AS (SELECT doc_id, lower(m[i] || g[i + 1] || m[i + 1]) AS phrase, length(m[i]) AS w FROM i WHERE i < len(m)
      UNION ALL SELECT doc_id, lower(m[i] || g[i + 1] || m[i + 1] || g[i + 2] || m[i + 2]), length(m[i]) FROM i WHERE i < len(m) - 1)
SELECT d.doc_id, count(ph.phrase) AS n_phrases, CAST(coalesce(sum(length(ph.phrase)), 0) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN ph ON ph.phrase = r.phrase GROUP BY d.doc_id""",
)
def phrase_matches(spark, sf):
    b = table(spark, sf, "benchmark")
    lists = [b.select(F.explode(F.regexp_extract_all("text", F.lit(p), 0)).alias("term")) for p in PHRASES]
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = LX.lexicon_spans(docs, "text", "doc_id", LX.union_terms(*lists), label="PHRASE")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_phrases"), F.coalesce(chars, F.lit(0)).alias("n_chars"))


@register("mask_with_entities", "M8 (two-phase) F10p N1 N3 V10 M1 J7 D7-role", "documents")
def mask_with_entities(spark, sf):
    """Entity spans (title-case runs labelled by length, standing in for a tagger's output) go
    through the conservative policy, the protected-span veto and the drug-lexicon veto, are made
    non-overlapping, tagged through the tag map, and masked together with the regex steps."""
    from ..operators import detect as D

    prof = default_profile(drug_lexicon_extra=P.BUILTIN_DRUGS)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    d = S.with_detector_spans(docs, "text", [QS._java(ENTITY_LIKE)], "ents")
    d = TK.with_tokens(d, "text", "toks")
    d = D.with_drug_spans(d, "text", "prot", prof.drug_lexicon)
    d, blk = S.with_blocks(d, "text")

    def labelled(e):
        surf = S.surface(F.col("text"), e, F.col(blk))
        n = F.size(F.split(F.trim(surf), r"\s+"))
        lab = F.when(n == 1, "LOC").when(n == 2, "PER").otherwise("GPE")
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), lab.alias("label"), surf.alias("src"))

    d = d.withColumn("ents", S.pinned(blk, F.transform("ents", labelled)))
    d = d.withColumn("ents", F.filter("ents", lambda e: PO.conservative(e["label"], e["src"])))
    d = d.withColumn("ents", S.pinned("prot", PO.veto_protected(F.col("ents"), F.col("prot"))))
    d = d.withColumn("lex_hits", PO.lexicon_hits(F.col("toks"), prof.drug_lexicon))
    d = d.withColumn("ents", S.pinned("lex_hits", PO.veto_lexicon(F.col("ents"), F.col("lex_hits"))))
    tags = F.create_map(*[x for k, v in prof.tag_map.items() for x in (F.lit(k), F.lit(v))])
    d = d.withColumn("ents", S.select_longest(F.transform("ents", lambda e: S.span(
        e["start"], e["end"], F.coalesce(F.element_at(tags, e["label"]), F.concat(F.lit("["), e["label"], F.lit("]"))), F.lit("entity")))))
    d = d.drop("toks", "lex_hits", "prot", blk)
    m = M.mask_text(d, "text", prof, out="masked", counts="c", protect=True, entities="ents")
    return m.select("doc_id", "masked", F.col("c.entities").alias("n_entities"), F.col("c.protected").alias("n_protected"),
                    M.count_total("c", STEP_NAMES + ["heur"]).alias("n_regex"))
