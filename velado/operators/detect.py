"""Detectors that turn text into spans (D3, D8-D14) and the medication protection set.

All detectors run inside the row (regex -> span arrays), so detection is a narrow projection.
Large lexicons use the token join in ``operators.lexicon`` instead of one alternation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S

_n = [0]


def _tmp(p):
    _n[0] += 1
    return f"__{p}_{_n[0]}"


def hard_detectors():
    """Evaluation-script regex set (D3) as ``(label, java_pattern)``."""
    return [(lab, P.ci(p) if icase else P.cs(p)) for lab, p, icase in P.HARD_REGEXES]


def lexicon_pattern(terms, wide=False):
    """One alternation of drug terms, longest first.

    Canonical form is whole-word; the wide form lets words be joined by spaces or ``-`` and allows
    a trailing registered/trademark sign, never inside a word.
    """
    terms = sorted({t.strip().lower() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    if not terms:
        return None
    if not wide:
        return P.ci(P.alternation(terms))
    alts = []
    for t in terms:
        parts = [P.quote_term(p) for p in t.split()]
        alts.append(r"(?:\s+|\-)+".join(parts) if len(parts) > 1 else parts[0])
    return P.ci(r"(?<!\w)(?:" + "|".join(alts) + r")(?:[®™])?(?!\w)")


def suffix_word_pattern(suffixes) -> str:
    """Words (as the capital-word rule delimits them) whose lower case ends with a suffix.

    Same start as the word rule (a word boundary, then a letter of the class and one more word
    character); the suffix must end the word: only hyphens may follow before a non-word character.
    One pass that yields only candidate words, instead of every word of the text.
    """
    suf = "|".join(P.quote_term(x) for x in sorted(set(suffixes), key=lambda t: (-len(t), t)))
    return P.ci(r"\b(?=[" + P.UPPER_CLASS + r"]" + P.WORD_TAIL + r")" + P.WORD_TAIL + r"*(?:" + suf + r")(?!" + P.WORD_TAIL + r"*\w)")


def _suffix_filter(text_col: str, spans_col: str, suffixes, units_re: str, radius: int, blocks: str):
    """Keep word spans ending with a drug suffix that have a unit (or digit) within ``radius`` chars."""
    suf = "(?U)(" + "|".join(P.quote_term(s) for s in suffixes) + ")$"
    t, b = F.col(text_col), F.col(blocks)

    def keep(x):
        word = F.lower(S.sub(t, x["start"], x["end"] - x["start"], b))
        lo = F.greatest(x["start"] - radius, F.lit(0))
        ctx = S.sub(t, lo, x["end"] + radius - lo, b)
        return word.rlike(suf) & ctx.rlike(P.ci(units_re))

    return S.pinned(blocks, F.filter(F.col(spans_col), keep))


def with_drug_spans(df: DataFrame, text: str, out: str, lexicon=(), wide: bool = False, merged: bool = True,
                    found: str | None = None) -> DataFrame:
    """Medication spans to protect (D14 = D8 + D10 + D11 [+ D12] + D13), merged (V1) by default.

    ``found`` names a column of spans that a lexicon table gave (``lexicon.lexicon_spans``; null: none).

    All rules run as one multi-detector extraction: a single relaxed-alternation pass skips rows
    where no rule can match, then each rule extracts its own spans.
    """
    dets = []
    lex = lexicon_pattern(lexicon, wide)
    if lex:
        dets.append(dict(out=_tmp("lex"), pattern=lex, label="DRUG", src="lexicon"))
    dets.append(dict(out=_tmp("ctx"), pattern=P.ci(P.DRUG_CONTEXT_WIDE if wide else P.DRUG_CONTEXT),
                     label="DRUG", src="context", group=2))
    dets.append(dict(out=_tmp("dose"), pattern=P.ci(P.DOSE_PATTERN_WIDE if wide else P.DOSE_PATTERN),
                     label="DRUG", src="dose"))
    if wide:
        dets.append(dict(out=_tmp("num"), pattern=P.ci(P.DRUG_NUMBER_PATTERN), label="DRUG", src="number"))
    sufs = P.DRUG_SUFFIXES_WIDE if wide else P.DRUG_SUFFIXES
    words = _tmp("words")
    dets.append(dict(out=words, pattern=suffix_word_pattern(sufs), label="DRUG", src="suffix"))
    df = S.with_regex_spans_multi(df, text, dets, scans=S.scan_columns)  # masking has no Python workers
    parts = [d["out"] for d in dets if d["out"] != words]
    c = _tmp("suf")
    df, blk = S.with_blocks(df, text)
    if wide:
        df = df.withColumn(c, _suffix_filter(text, words, P.DRUG_SUFFIXES_WIDE, P.DOSE_UNITS_WIDE + r"|\d", 25, blk))
    else:
        df = df.withColumn(c, _suffix_filter(text, words, P.DRUG_SUFFIXES, P.DOSE_UNITS, 20, blk))
    parts.append(c)
    df = df.drop(words, blk)
    allc = F.concat(*[F.col(p) for p in parts], *([F.coalesce(F.col(found), S.empty_spans())] if found else []))
    df = df.withColumn(out, S.merge_spans(allc) if merged else allc)
    return df.drop(*parts)
