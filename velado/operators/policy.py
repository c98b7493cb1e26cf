"""Label policies and vetoes over entity spans (F1p-F12p, N1, N3, O4).

Every predicate is a boolean Column over a span's surface text, so a policy is one ``filter``
on the span array (or on span rows); lexicon tests are hashed sets of literals for the fixed lists
of a profile, or a checked broadcast join for large ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def is_drug_name(t: Column, suffixes=None) -> Column:
    """Any whitespace token, or the whole text, ends with a drug suffix; length > 2 (F2p)."""
    suffixes = P.POLICY_DRUG_SUFFIXES if suffixes is None else suffixes
    s = F.lower(F.trim(t))
    suf = "(" + "|".join(P.quote_term(x) for x in suffixes) + r")(\s|$)"
    return (F.length(s) > 2) & s.rlike("(?U)" + suf)


def is_generic_acronym(t: Column, lo: int = 3, hi: int = 8) -> Column:
    """All upper case (with at least one cased letter), ``lo..hi`` characters (F3p)."""
    s = F.trim(t)
    return (s == F.upper(s)) & (s != F.lower(s)) & F.length(s).between(lo, hi)


def looks_like_health_org(t: Column) -> Column:
    """Has a hospital keyword, or at least three words (F5p)."""
    kw = "(" + "|".join(P.quote_term(k) for k in P.HOSPITAL_KEYWORDS) + ")"
    return F.lower(F.trim(t)).rlike("(?U)" + kw) | (F.size(F.split(F.trim(t), r"\s+")) >= 3)


def is_safe_term(t: Column) -> Column:
    """Exact lower-case membership in the safe health-service terms (F6p)."""
    return F.array_contains(_lit_array(P.SAFE_ORG_TERMS), F.lower(F.trim(t)))


def is_plausible_person(t: Column) -> Column:
    """Not an acronym, not a drug, and two or more tokens or a common given name (F4p)."""
    s = F.trim(t)
    many = F.size(F.split(s, r"\s+")) >= 2
    given = F.array_contains(_lit_array(P.COMMON_GIVEN_NAMES), F.lower(s))
    return (s != "") & ~is_generic_acronym(s) & ~is_drug_name(s) & (many | given)


def precision_first(label: Column, surface: Column, secondary: Column | bool = False) -> Column:
    """Keep-entity policy "precision first" (F9p): PER always; ORG unless safe term, drug, or not a
    health organisation; LOC/GPE/FAC always; spans of the secondary model only if LOC/GPE/FAC."""
    sec = secondary if isinstance(secondary, Column) else F.lit(secondary)
    org_ok = ~is_safe_term(surface) & ~is_drug_name(surface) & looks_like_health_org(surface)
    main = (label == "PER") | ((label == "ORG") & org_ok) | label.isin("LOC", "GPE", "FAC")
    return F.when(sec, label.isin(*P.SECONDARY_SAFE_LABELS)).otherwise(main)


def conservative(label: Column, surface: Column) -> Column:
    """Keep-entity policy "conservative" (F10p): PER if plausible and not a drug; GPE/LOC unless a
    safe term or a drug; nothing else.  Overlap with drug spans is vetoed separately (N1)."""
    per = (label == "PER") & is_plausible_person(surface) & ~is_drug_name(surface)
    geo = label.isin("GPE", "LOC") & ~is_safe_term(surface) & ~is_drug_name(surface)
    return per | geo


def allowed_labels(requested, allowed=P.CONSERVATIVE_LABELS):
    """Requested labels intersected with the allowed set (O4), order kept."""
    return [x for x in requested if x in set(allowed)]


def label_filter(spans: Column, labels) -> Column:
    """Keep spans whose label is in ``labels`` (F1p)."""
    return F.filter(spans, lambda s: s["label"].isin(*list(labels)))


def veto_protected(entities: Column, protected: Column) -> Column:
    """Drop entity spans that overlap a protected (medication) span."""
    return F.filter(entities, lambda e: ~F.exists(protected, lambda p: S.overlaps(e, p)))


def lexicon_hits(toks: Column, lexicon) -> Column:
    """The document's tokens that are drug-lexicon terms (usually none): materialise once per row."""
    lex = sorted({t.lower() for t in lexicon})  # literals: one hashed set in the plan
    return F.filter(toks, lambda t: F.lower(t["tok"]).isin(lex))


def veto_lexicon(entities: Column, toks: Column, lexicon=None) -> Column:
    """Drop entity spans with an overlapping token in the drug lexicon.

    ``toks`` is a materialised token array; pass ``lexicon=None`` when it already holds only the
    lexicon hits (``lexicon_hits``), which makes the test per entity proportional to the hits.
    """
    if lexicon is None:
        return F.filter(entities, lambda e: ~F.exists(toks, lambda t: S.overlaps(e, t)))
    lex = sorted({t.lower() for t in lexicon})
    return F.filter(entities, lambda e: ~F.exists(toks, lambda t: S.overlaps(e, t) & F.lower(t["tok"]).isin(lex)))


def in_drug_lexicon(t: Column, lexicon) -> Column:
    """Whole value, trimmed and lower-cased, is a lexicon term (F11p)."""
    return F.lower(F.trim(t)).isin(sorted({x.lower() for x in lexicon}))


def drug_label(label: Column, drug_labels=tuple(P.DRUG_LABELS)) -> Column:
    """Entity label, upper-cased, is one of the drug labels (F12p, drug-only corpora)."""
    return F.upper(label).isin(*drug_labels)


def probable_drug_segment(text: Column, s: Column, lexicon, blocks: Column | None = None, window: int = 40,
                          protected: Column | None = None) -> Column:
    """A span looks like medication (F7p): it overlaps a protected span, holds a lexicon token, a word
    with a dose or a number, or a treatment word and ``con`` stand right before it within ``window``
    characters."""
    seg = S.surface(text, s, blocks)
    tests = [seg.rlike(P.ci(P.DOSE_PATTERN_WIDE)), seg.rlike(P.ci(P.DRUG_NUMBER_PATTERN)),
             S.left_context(text, s["start"], window, blocks).rlike(P.ci(P.TREATMENT_BEFORE))]
    if lexicon:
        toks = F.regexp_extract_all(F.lower(seg), F.lit(P.SEGMENT_WORD), F.lit(0))
        tests.append(F.arrays_overlap(toks, _lit_array(sorted({t.lower() for t in lexicon}))))
    if protected is not None:
        tests.append(F.exists(protected, lambda p: S.overlaps(s, p)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
