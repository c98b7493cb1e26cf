"""Table masking operators (M3, M8, M9, M10, M11, M6/M7 protection, A1 audit counts).

Each text step is materialised as its own column: the step output is referenced twice (its
count and the next step), so Catalyst keeps the projections apart and each pattern runs exactly
once per cell.  The whole masking job stays one narrow stage: scan -> projections -> write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import text as T
from ..functions.structured import mask_struct_value
from . import detect as D
from . import policy as PO
from . import tokens as TK

_n = [0]


def _tmp(p):
    _n[0] += 1
    return f"__{p}_{_n[0]}"


def regex_chain_df(df: DataFrame, src: str, steps, out: str, counts: str) -> DataFrame:
    """Apply ``(name, pattern, repl)`` steps to column ``src``; ``out`` text, ``counts`` struct."""
    cur = src
    cnt_cols = []
    # One pass over the original text with every step's pattern decides whether any step can fire
    # (a step sees earlier tags, which never match later patterns); most cells skip the chain.
    hit = _tmp("any")
    if steps:
        df = df.withColumn(hit, S.any_match(F.col(src), [p for _, p, _ in steps]))
    for name, pattern, repl in steps:
        c = _tmp(f"n_{name}")
        nxt = _tmp("t")
        need = P.need_of(pattern)
        may = F.col(hit) & F.col(cur).rlike(need) if need else F.col(hit)
        df = df.withColumn(c, F.when(may, F.coalesce(F.regexp_count(F.col(cur), F.lit(pattern)), F.lit(0)))
                           .otherwise(F.lit(0)).cast("int"))
        # Most cells have no match for most patterns: the count pass decides, the replace pass
        # runs only where something matched.
        df = df.withColumn(nxt, F.when(F.col(c) > 0, F.regexp_replace(F.col(cur), F.lit(pattern), F.lit(repl)))
                           .otherwise(F.col(cur)))
        cnt_cols.append((name, c))
        if cur != src:
            df = df.drop(cur)
        cur = nxt
    if cur == src:
        df = df.withColumn(out, F.col(src))
    else:
        df = df.withColumn(out, F.col(cur)).drop(cur) if out != cur else df
    df = df.withColumn(counts, F.struct(*[F.col(c).alias(n) for n, c in cnt_cols]) if cnt_cols else F.struct())
    return df.drop(*[c for _, c in cnt_cols], *([hit] if steps else []))


def mask_text(
    df: DataFrame,
    col: str,
    profile,
    out: str | None = None,
    counts: str | None = None,
    protect: bool | None = None,
    drug_lexicon=None,
    entities: str | None = None,
    protected: str | None = None,
    lexicon_spans: str | None = None,
) -> DataFrame:
    """Mask one free-text column (M8 without model spans).

    Order: protect medication (D14 -> merged spans), regex keys in profile order, gazetteer,
    residence heuristic, restore.  ``counts`` gets a struct with one int per step plus
    ``protected`` (number of merged protected spans).  Blank text is returned unchanged, counts 0.
    ``protected`` names a column that holds the merged protected spans already (dropped here); ``lexicon_spans`` one of
    spans that a drug table gave, protected with the rest.
    """
    out = out or col
    counts = counts or f"{col}__counts"
    protect = profile.protect_drugs if protect is None else protect
    steps = T.text_steps(profile)
    src = col
    if profile.null_as_empty:
        src = _tmp("src")
        df = df.withColumn(src, F.coalesce(F.col(col), F.lit("")))
    blank = _tmp("blank")
    df = df.withColumn(blank, T.is_blank(F.col(src)))
    if not protect:
        tmp_out, tmp_cnt = _tmp("o"), _tmp("c")
        df = regex_chain_df(df, src, steps, tmp_out, tmp_cnt)
        df = df.withColumn(tmp_cnt, F.struct(F.col(tmp_cnt + ".*"), F.lit(0).alias("protected")))
    else:
        lex = profile.drug_lexicon if drug_lexicon is None else drug_lexicon
        prot = protected or _tmp("prot")
        if not protected:
            df = D.with_drug_spans(df, src, prot, lex, wide=profile.wide_drug_rules, found=lexicon_spans)
        segs = _tmp("segs")
        df, blk = S.with_blocks(df, src)
        if entities:
            # Two-phase M8: accepted entity spans (already vetoed, non-overlapping, label = tag)
            # become closed segments holding their tag; protected spans stay closed as they are.
            both = _tmp("both")
            ent = F.transform(F.col(entities), lambda e: S.span(e["start"], e["end"], e["label"], F.lit("entity")))
            prot_src = F.transform(F.col(prot), lambda p: S.span(p["start"], p["end"], p["label"], F.lit("protect")))
            df = df.withColumn(both, S.sort_spans(F.concat(prot_src, ent)))
            df = df.withColumn(segs, S.pinned(blk, S.pinned(both, S.segments(F.col(src), F.col(both), F.col(blk), tag_src="entity"))))
            df = df.withColumn("__n_entities", F.size(F.col(entities))).drop(both, blk)
        else:
            df = df.withColumn(segs, S.pinned(blk, S.segments(F.col(src), F.col(prot), F.col(blk)))).drop(blk)
        cnt_cols = []
        # Prefilter on what the steps see: the whole text where it is one open segment, else each
        # open segment, since a segment edge can make or end a match.
        hit = _tmp("any")
        pats = [p for _, p, _ in steps]
        whole = F.size(F.col(prot)) == 0
        if entities:
            whole = whole & (F.coalesce(F.size(F.col(entities)), F.lit(0)) <= 0)
        parts = F.exists(F.col(segs), lambda s: ~s["prot"] & S.any_match(s["txt"], pats))
        df = df.withColumn(hit, F.coalesce(F.when(whole, S.any_match(F.col(src), pats)).otherwise(parts), F.lit(False)))
        for name, pattern, repl in steps:
            c, nxt = _tmp(f"n_{name}"), _tmp("segs")
            pat = F.lit(pattern)
            df = df.withColumn(c, F.when(F.col(hit), F.aggregate(F.col(segs), F.lit(0), T._count_open(pat)))
                               .otherwise(F.lit(0)).cast("int"))
            df = df.withColumn(nxt, F.when(F.col(c) > 0, F.transform(F.col(segs), T._replace_open(pat, repl)))
                               .otherwise(F.col(segs))).drop(segs)
            segs = nxt
            cnt_cols.append((name, c))
        tmp_out, tmp_cnt = _tmp("o"), _tmp("c")
        df = df.withColumn(tmp_out, S.join_segments(F.col(segs)))
        extra = [F.col("__n_entities").alias("entities")] if entities else []
        df = df.withColumn(
            tmp_cnt,
            F.struct(*[F.col(c).alias(n) for n, c in cnt_cols], F.size(F.col(prot)).alias("protected"), *extra),
        )
        df = df.drop(segs, prot, hit, *[c for _, c in cnt_cols], *(["__n_entities"] if entities else []))
    zero = F.struct(*[F.lit(0).alias(n) for n, _, _ in steps], F.lit(0).alias("protected"),
                    *([F.lit(0).alias("entities")] if (protect and entities) else []))
    df = df.withColumn(counts, F.when(F.col(blank), zero).otherwise(F.col(tmp_cnt)))
    df = df.withColumn(out, F.when(F.col(blank), F.col(src)).otherwise(F.col(tmp_out)))
    drop = [blank, tmp_out, tmp_cnt] + ([src] if src != col else [])
    return df.drop(*[d for d in drop if d != out])


def entity_tags(text: str, entities: str, profile, protected: str, lexicon_hits: str | None, blocks: str):
    """The entity phase (M8, F1p, N1, N3, V10, M1): tagger spans to the closed segments that replace them.

    Labels outside the profile's ``ner_labels`` go, then spans that touch protected medication or a
    token of the drug lexicon; of what overlaps the longest stays.  A span's label becomes its tag, or
    one block character (``redact``), whatever its length; ``redact_length`` in the profile's masking settings
    gives one for each character, as the oldest version did, which tells the length.
    """
    kept = PO.label_filter(F.col(entities), profile.ner_labels)
    kept = S.pinned(protected, PO.veto_protected(kept, F.col(protected)))
    if lexicon_hits:
        kept = S.pinned(lexicon_hits, PO.veto_lexicon(kept, F.col(lexicon_hits)))
    pairs = [x for k, v in profile.tag_map.items() for x in (F.lit(k), F.lit(v))]
    tags = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")

    def closed(e):
        tag = F.coalesce(F.element_at(tags, e["label"]), F.concat(F.lit("["), e["label"], F.lit("]")))
        if profile.masking_strategy == "redact":
            tag = F.repeat(F.lit(P.REDACT_CHAR), e["end"] - e["start"]) if profile.redact_length else F.lit(P.REDACT_CHAR)
        return S.span(e["start"], e["end"], tag, e["label"])

    return S.pinned(blocks, F.transform(S.select_longest(kept), closed))


def mask_entities(df: DataFrame, text: str, entities: str, profile, out: str = "masked", counts: str = "c",
                  lexicon_spans: str | None = None) -> DataFrame:
    """Two-phase masking of one column (M8): the spans of a tagger in ``entities``, then the regex steps.

    ``counts`` has one number for each step, and ``ents``: the labels that were masked.  ``lexicon_spans`` names a
    column of spans found by a lexicon table, which are protected as the profile's own terms are.
    """
    prot, tags, blk = _tmp("prot"), _tmp("tags"), _tmp("blk")
    df = D.with_drug_spans(df, text, prot, profile.drug_lexicon, wide=profile.wide_drug_rules, found=lexicon_spans)
    hits = None
    if profile.drug_lexicon:
        toks, hits = _tmp("toks"), _tmp("hits")
        df = TK.with_tokens(df, text, toks).withColumn(hits, PO.lexicon_hits(F.col(toks), profile.drug_lexicon)).drop(toks)
    df, blk = S.with_blocks(df, text, blk)
    df = df.withColumn(tags, entity_tags(text, entities, profile, prot, hits, blk)).drop(blk, *([hits] if hits else []))
    df = mask_text(df, text, profile, out=out, counts=counts, protect=True, entities=tags, protected=prot)
    ents = S.pinned(tags, F.transform(tags, lambda e: e["src"]))
    return df.withColumn(counts, F.struct(F.col(f"{counts}.*"), ents.alias("ents"))).drop(tags)


def count_total(counts_col: str, names) -> F.Column:
    """Sum of detections in a counts struct (``per_col`` contribution); ``protected`` excluded."""
    terms = [F.col(f"{counts_col}.{n}") for n in names if n != "protected"]
    if not terms:
        return F.lit(0)
    tot = terms[0]
    for t in terms[1:]:
        tot = tot + t
    return tot


def mask_structured(df: DataFrame, profile, counts_prefix: str = "__sc_") -> DataFrame:
    """Mask structured columns by declared kind (M3/M4/M5); adds one int count column per masked column."""
    for c in df.columns:
        kind = profile.stypes.get(c)
        if kind is None or c in profile.text_cols:
            continue
        val, n = mask_struct_value(F.col(c), kind, profile, df.schema[c].dataType)
        df = df.withColumn(counts_prefix + c, n).withColumn(c, val)
    return df


def mask_table(df: DataFrame, profile, protect: bool | None = None):
    """Mask a whole table by profile in one pass.

    Returns ``(masked_df_with_count_columns, text_cols_present, struct_cols)``.  Output column
    order of the input is kept; count columns are appended with a ``__`` prefix.
    """
    present = []
    for c in profile.text_cols:
        if c not in df.columns:
            # A profile naming a missing text column warns and goes on.
            print(f"[warn] text column not found: {c}")
            continue
        present.append(c)
        df = mask_text(df, c, profile, out=c, counts=f"__tc_{c}", protect=protect)
    df = mask_structured(df, profile)
    struct_cols = [c for c in df.columns if c.startswith("__sc_")]
    return df, present, struct_cols
