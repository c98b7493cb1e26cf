"""Free-text masking expressions (detectors D1/D2/D5/D6, masks M4/M6/M7/M9, blank short-circuit F8p).

Everything is a chain of built-in ``regexp_replace`` / ``regexp_count`` calls: one narrow
projection, evaluated in the JVM, no Python worker.  Counts are taken on the input of each step
(the text as masked so far), as the sequential reference does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .spans import join_segments


def is_blank(text: Column) -> Column:
    """Null, empty or only whitespace (Unicode)."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def regex_chain(text: Column, steps):
    """Apply ``(name, pattern, replacement)`` steps in order; return ``(text, {name: count})``."""
    counts = {}
    cur = text
    for name, pattern, repl in steps:
        counts[name] = F.coalesce(F.regexp_count(cur, F.lit(pattern)), F.lit(0)).cast("int")
        cur = F.regexp_replace(cur, F.lit(pattern), F.lit(repl))
    return cur, counts


def gazetteer_step(terms):
    """Whole-word, case-insensitive alternation of the terms (D5), longest first."""
    if not terms:
        return None
    return ("gazetteer", P.ci(P.alternation(terms)), "[LOC]")


def heuristic_step():
    """``vive en X`` -> ``vive en [LOC]`` (D6); Java group reference ``$1``."""
    return ("heur", P.ci(P.HEURISTIC_RESIDENCE), "$1 [LOC]")


def text_steps(profile, with_gazetteer=True, with_heuristic=True):
    steps = list(profile.regex_steps())
    if with_gazetteer:
        g = gazetteer_step(profile.gazetteer)
        if g:
            steps.append(g)
    if with_heuristic:
        steps.append(heuristic_step())
    return steps


def mask_plain(text: Column, profile, with_gazetteer=True, with_heuristic=True):
    """Regex, gazetteer and heuristic masking of one text column without protected segments.

    Returns ``(masked_text, {step: count})``; blank text passes unchanged with zero counts.
    """
    steps = text_steps(profile, with_gazetteer, with_heuristic)
    if profile.null_as_empty:
        text = F.coalesce(text, F.lit(""))
    out, counts = regex_chain(text, steps)
    blank = is_blank(text)
    out = F.when(blank, text).otherwise(out)
    counts = {k: F.when(blank, F.lit(0)).otherwise(v) for k, v in counts.items()}
    return out, counts


def _count_open(pat):
    return lambda acc, s: acc + F.when(s["prot"], F.lit(0)).otherwise(F.regexp_count(s["txt"], pat))


def _replace_open(pat, repl):
    return lambda s: F.when(s["prot"], s).otherwise(
        F.struct(F.regexp_replace(s["txt"], pat, F.lit(repl)).alias("txt"), s["prot"].alias("prot"))
    )


def rules_first(text: Column):
    """Notebook variant (D2/M9): DNI, NIE, then phone to ``[TELEFONO]``, before any model."""
    steps = []
    for name, pat, tag, icase in P.RULES_FIRST:
        steps.append((name, P.ci(pat) if icase else P.cs(pat), tag))
    return regex_chain(text, steps)


def mask_full(value: Column, strategy="tag", token="[X]") -> Column:
    """Whole-value mask (M4): tag, or one block character per character (at least one)."""
    if strategy == "tag":
        return F.when(value.isNotNull(), F.lit(token))
    s = value.cast("string")
    return F.when(value.isNotNull(), F.repeat(F.lit(P.REDACT_CHAR), F.greatest(F.length(s), F.lit(1))))


def unicode_trim(text: Column) -> Column:
    """Strip Unicode whitespace from both ends (``str.strip``)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


__all__ = [
    "is_blank",
    "regex_chain",
    "mask_plain",
    "rules_first",
    "mask_full",
    "unicode_trim",
    "join_segments",
    "text_steps",
]
