"""Span algebra as Spark Column expressions.

A span is ``struct<start:int, end:int, label:string, src:string>``: half-open ``[start, end)`` in
code points, 0-based.  Documents are the parallel unit: every operator here works inside one row
(``transform`` / ``aggregate`` / ``filter``), so nothing shuffles.

Offsets come from ``regexp_extract_all`` (the matches) and ``split`` (the gaps between them):
``start_i = sum(len(gap_0..gap_i)) + sum(len(match_0..match_{i-1}))``.  ``regexp_instr`` is not
used because it counts UTF-16 units while ``length``/``substring`` count code points.

The prefix sums are computed in Arrow batches (``arrow_scans``); those of tokens in blocks in the row (``scan_columns``).
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import any_of, need_of

SPAN_FIELDS = "start:int,end:int,label:string,src:string"
SPAN_TYPE = f"struct<{SPAN_FIELDS}>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"

_tmp_counter = [0]


def _tmp(prefix: str) -> str:
    _tmp_counter[0] += 1
    return f"__{prefix}_{_tmp_counter[0]}"


def empty_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(start, end, label=None, src=None) -> Column:
    """Build one span struct."""
    lab = label if isinstance(label, Column) else F.lit(label).cast("string")
    sr = src if isinstance(src, Column) else F.lit(src).cast("string")
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        lab.alias("label"),
        sr.alias("src"),
    )


def pinned(name: str, expr: Column) -> Column:
    """``expr`` guarded by ``name IS NOT NULL``.

    Catalyst inlines a projected column into its consumer when the consumer references it once;
    if that one reference sits inside a lambda, the producer would be re-evaluated per element.
    The guard is a second reference, so the producer stays materialised once per row.
    """
    return F.when(F.col(name).isNotNull(), expr)


def explode_rows(df: DataFrame, arr: Column, keep, alias: str = "s", pos: str | None = None) -> DataFrame:
    """One row per array element, dropping empty arrays.

    ``explode`` makes Catalyst infer ``size(arr) > 0`` and push it below the projections that
    build ``arr``, inlining (and so re-evaluating) the whole span pipeline; ``explode_outer``
    followed by a filter on the generated column keeps the arrays computed once.
    """
    keep = [F.col(k) if isinstance(k, str) else k for k in keep]
    if pos:
        x = df.select(*keep, F.posexplode_outer(arr).alias(pos, alias))
    else:
        x = df.select(*keep, F.explode_outer(arr).alias(alias))
    return x.filter(F.col(alias).isNotNull())


def seq0(n: Column) -> Column:
    """``[0, n)`` as an int array; empty for ``n <= 0`` (``sequence(0,-1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


# ---------------------------------------------------------------------------------------------
# Positioned substrings.  ``substring(text, pos, n)`` walks the UTF-8 bytes from the start to
# find code point ``pos``, so cutting many spans out of one long text is quadratic.  A text kept
# as blocks of ``BLOCK`` code points (one regex pass) gives any substring from the few blocks it
# touches: O(n + BLOCK) per cut.
# ---------------------------------------------------------------------------------------------
BLOCK = 64


def text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def with_blocks(df: DataFrame, text: str, out: str | None = None) -> tuple[DataFrame, str]:
    out = out or _tmp("blocks")
    return df.withColumn(out, text_blocks(F.col(text))), out


def sub(text: Column, start0, length, blocks: Column | None = None) -> Column:
    """Code points ``[start0, start0 + length)`` of the text (0-based), from blocks when given."""
    start0 = start0 if isinstance(start0, Column) else F.lit(start0)
    length = length if isinstance(length, Column) else F.lit(length)
    if blocks is None:
        return F.substring(text, start0 + 1, F.greatest(length, F.lit(0)))
    ln = F.greatest(length, F.lit(0))
    st = F.greatest(start0, F.lit(0))
    b0 = F.floor(st / BLOCK).cast("int")
    b1 = F.floor((st + ln - 1) / BLOCK).cast("int")
    piece = F.array_join(F.slice(blocks, b0 + 1, F.greatest(b1 - b0 + 1, F.lit(0))), "")
    return F.when(ln == 0, F.lit("")).otherwise(F.substring(piece, st - b0 * BLOCK + 1, ln))


def text_length(text: Column, blocks: Column | None = None) -> Column:
    if blocks is None:
        return F.length(text)
    return F.when(F.size(blocks) == 0, F.lit(0)).otherwise(
        (F.size(blocks) - 1) * BLOCK + F.length(F.try_element_at(blocks, F.lit(-1)))
    )


# ---------------------------------------------------------------------------------------------
# Prefix scans (sum / max) over int array columns, blockwise.
# ---------------------------------------------------------------------------------------------
def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_str(v) -> str:
    """Spark SQL string literal (or NULL)."""
    if v is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list_tools():
    """Helpers of the Arrow functions below, made inside them since workers need not have this package: ``flat`` gives the
    lengths of a list column's rows (0 for null ones) and its elements; ``relist`` puts elements back into such rows."""

    def flat(rows: pa.Array):
        return rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), rows.flatten()

    def relist(values: pa.Array, sizes, rows: pa.Array) -> pa.Array:
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(at, values, mask=rows.is_null())

    return flat, relist


@lru_cache(maxsize=None)
def _scan_udf(op: str, inclusive: bool):
    """Prefix scan of an array's elements: all rows of an Arrow batch at once.  A null element makes a sum null from there
    on; a maximum passes over it."""
    flatten, relist = _list_tools()

    def scan(rows: pa.Array) -> pa.Array:
        sizes, flat = flatten(rows)
        none = flat.is_null().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)

        def sums(x):
            upto = np.concatenate([[0], np.cumsum(x)])
            return upto[1 if inclusive else 0:len(x) + (1 if inclusive else 0)] - upto[first]

        if op == "sum":
            out = sums(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            gone = sums(none.astype(np.int64)) > 0
        else:
            low = -(2**31)
            lift = row * 2**33
            top = np.maximum.accumulate(flat.fill_null(low).to_numpy(zero_copy_only=False).astype(np.int64) + lift) - lift
            out = top if inclusive else np.where(np.arange(len(top)) == first, low, np.concatenate([[low], top[:-1]])[:len(top)])
            gone = np.zeros(len(out), bool)
        return relist(pa.array(out, mask=gone).cast(pa.int32()), sizes, rows)

    # Marked so that Catalyst keeps the result as a column: it would inline it into lambdas of later projections.
    return F.arrow_udf(scan, "array<int>").asNondeterministic()


def arrow_scans(df: DataFrame, pairs, op: str = "sum", inclusive: bool = False) -> DataFrame:
    """``scan_columns`` in Arrow batches: lambdas are evaluated element by element, here all rows of a batch are scanned at
    once and all pairs share one pass.  Linear in the elements."""
    if op not in ("sum", "max"):
        raise ValueError(op)
    one = _scan_udf(op, inclusive)
    return df.select("*", *[one(F.col(a).cast("array<int>")).alias(o) for a, o in pairs])


def scan_columns(df: DataFrame, pairs, op: str = "sum", inclusive: bool = False) -> DataFrame:
    """For each ``(arr, out)`` add ``out`` = prefix scan of int array column ``arr``.

    Three levels of blocks of ``B = max(4, ceil(cbrt(n)))`` elements: totals of the blocks and of blocks of blocks by scalar
    ``aggregate`` (no array concatenation), then bases from the top down; each element adds the scalar scan of its own
    block prefix.  Cost O(n * B) per row instead of O(n^2) for a concat fold.
    All arrays advance level by level, so the plan has six projections whatever their number.
    The expressions are SQL text: one JVM call each instead of hundreds of Column calls.
    """
    if op == "sum":
        zero, comb = "0", "(a, x) -> a + x"
    elif op == "max":
        zero, comb = str(-(2**31)), "(a, x) -> greatest(a, x)"
    else:
        raise ValueError(op)
    merge = "{} + {}" if op == "sum" else "greatest({}, {})"
    extra = 1 if inclusive else 0
    names = [(_q(a), o, *(_tmp(x) for x in ("blk", "tot", "top", "sky", "base"))) for a, o in pairs]

    def totals(a, blk):
        return (f"transform(CASE WHEN size({a}) > 0 THEN sequence(0, cast(ceil(size({a}) / {blk}) as int) - 1) "
                f"ELSE cast(array() as array<int>) END, b -> aggregate(slice({a}, b * {blk} + 1, {blk}), {zero}, {comb}))")

    def scan(a, base, blk, more):
        own = f"aggregate(slice({a}, cast(i div {blk} as int) * {blk} + 1, i - cast(i div {blk} as int) * {blk} + {more}), {zero}, {comb})"
        at = f"element_at({base}, cast(i div {blk} as int) + 1)"
        return f"CASE WHEN {base} IS NOT NULL THEN transform({a}, (x, i) -> {merge.format(at, own)}) END"

    df = df.select("*", *[F.expr(f"cast(greatest(4, ceil(cbrt(size({a})))) as int)").alias(blk) for a, _, blk, *_ in names])
    df = df.select("*", *[F.expr(totals(a, _q(blk))).alias(tot) for a, _, blk, tot, *_ in names])
    df = df.select("*", *[F.expr(totals(_q(tot), _q(blk))).alias(top) for _, _, blk, tot, top, *_ in names])
    df = df.select("*", *[F.expr(
        f"transform({_q(top)}, (t, b) -> aggregate(slice({_q(top)}, 1, b), {zero}, {comb}))").alias(sky)
        for *_, top, sky, _ in names])
    df = df.select("*", *[F.expr(scan(_q(tot), _q(sky), _q(blk), 0)).alias(base) for _, _, blk, tot, _, sky, base in names])
    df = df.select("*", *[F.expr(scan(a, _q(base), _q(blk), extra)).alias(o) for a, o, blk, *_, base in names])
    return df.drop(*[c for _, _, *cols in names for c in cols])


def scan_column(df: DataFrame, arr: str, out: str, op: str = "sum", inclusive: bool = False) -> DataFrame:
    return scan_columns(df, [(arr, out)], op, inclusive)


# ---------------------------------------------------------------------------------------------
# Regex to spans
# ---------------------------------------------------------------------------------------------
def any_match(text: Column, patterns) -> Column:
    """Whether any of the patterns matches somewhere in the text.  Patterns that need a certain character are looked for
    only where the text has it: finding one character takes far less than trying an alternation at every place."""
    found, groups = F.lit(False), {}
    for p in patterns:
        groups.setdefault(need_of(p), []).append(p)
    for need, group in groups.items():
        one = reduce(lambda a, b: a | b, [text.rlike(p) for p in any_of(group)] or [F.lit(False)])
        found = found | (text.rlike(need) & one if need else one)
    return F.coalesce(found, F.lit(False))


def with_regex_spans_multi(df: DataFrame, text: str, detectors, with_surface: bool = False, scans=arrow_scans) -> DataFrame:
    """Add one span-array column per detector ``dict(out, pattern, label, src, group)``.

    Each detector scans the whole text twice (matches, then gaps); ``group > 0`` returns the span
    of that group, which must end where the whole match ends (medication-context rules).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    ds = []
    for d in detectors:
        ds.append(dict(d, m=_tmp("m"), g=_tmp("g"), gl=_tmp("gl"), pl=_tmp("pl"), bs=_tmp("bs"), en=_tmp("en"),
                       mg=_tmp("mg") if d.get("group") else None))
    # One test of the whole text decides whether any detector can match the row at all; rows
    # with no candidate skip every extraction (most rows, for sparse detectors).
    hit = _tmp("any")
    df = df.withColumn(hit, any_match(t, [d["pattern"] for d in ds]))
    empty = F.array().cast("array<string>")
    df = df.select("*", *[F.when(F.col(hit), F.regexp_extract_all(t, F.lit(d["pattern"]), F.lit(0))).otherwise(empty)
                          .alias(d["m"]) for d in ds]).drop(hit)
    cols = []
    for d in ds:
        # Gaps are needed only when there is a match; most detectors find none in most rows.
        cols.append(F.when(F.size(F.col(d["m"])) > 0, F.split(t, d["pattern"], -1))
                    .otherwise(F.array().cast("array<string>")).alias(d["g"]))
        if d["mg"]:
            cols.append(F.when(F.size(F.col(d["m"])) > 0, F.regexp_extract_all(t, F.lit(d["pattern"]), F.lit(d["group"])))
                        .otherwise(F.array().cast("array<string>")).alias(d["mg"]))
    df = df.select("*", *cols)
    df = df.select("*", *[F.expr(f"transform(slice({_q(d['g'])}, 1, size({_q(d['m'])})), x -> length(x))").alias(d["gl"])
                          for d in ds])
    df = df.select(*[c for c in df.columns if c not in {d["g"] for d in ds}],
                   *[F.expr(f"zip_with({_q(d['gl'])}, {_q(d['m'])}, (a, b) -> a + length(b))").alias(d["pl"]) for d in ds])
    df = scans(df, [(d["pl"], d["bs"]) for d in ds], "sum", inclusive=False)
    # Starts and ends as arrays, zipped into structs as a whole: no struct is built element by element in a lambda.
    df = df.select("*", *[F.expr(f"zip_with({_q(d['bs'])}, {_q(d['pl'])}, (a, b) -> a + b)").alias(d["en"]) for d in ds])

    def build(d):
        if d["mg"]:
            start = F.expr(f"zip_with({_q(d['en'])}, {_q(d['mg'])}, (a, b) -> a - length(b))")
        else:
            start = F.expr(f"zip_with({_q(d['bs'])}, {_q(d['gl'])}, (a, b) -> a + b)")
        n = F.size(F.col(d["m"]))
        fields = [start.alias("start"), F.col(d["en"]).alias("end"), F.array_repeat(F.lit(d.get("label")).cast("string"), n).alias("label"),
                  F.array_repeat(F.lit(d.get("src")).cast("string"), n).alias("src")]
        if with_surface:
            fields.append(F.col(d["mg"] or d["m"]).alias("surface"))
        return F.arrays_zip(*fields).alias(d["out"])

    df = df.select("*", *[build(d) for d in ds])
    return df.drop(*[c for d in ds for c in (d["m"], d["gl"], d["pl"], d["bs"], d["en"], d["mg"]) if c])


def with_regex_spans(
    df: DataFrame,
    text: str,
    pattern: str,
    out: str,
    label: str | None = None,
    src: str | None = None,
    group: int = 0,
    with_surface: bool = False,
    scans=arrow_scans,
) -> DataFrame:
    """Add ``out``: spans of every non-overlapping match of ``pattern`` in column ``text``."""
    det = dict(out=out, pattern=pattern, label=label, src=src, group=group)
    return with_regex_spans_multi(df, text, [det], with_surface, scans)


def with_detector_spans(df: DataFrame, text: str, detectors, out: str) -> DataFrame:
    """Concatenate spans of several ``(label, pattern[, group])`` detectors (each over the whole text)."""
    if not detectors:
        return df.withColumn(out, empty_spans())
    dets = []
    for i, det in enumerate(detectors):
        label, pattern = det[0], det[1]
        group = det[2] if len(det) > 2 else 0
        dets.append(dict(out=_tmp(f"det{i}"), pattern=pattern, label=label, src=f"re:{label}", group=group))
    df = with_regex_spans_multi(df, text, dets)
    cols = [d["out"] for d in dets]
    return df.withColumn(out, F.concat(*[F.col(c) for c in cols])).drop(*cols)


# ---------------------------------------------------------------------------------------------
# Interval algebra inside a row
# ---------------------------------------------------------------------------------------------
def overlaps(a: Column, b: Column) -> Column:
    """Half-open overlap test (V2)."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def sort_spans(spans: Column) -> Column:
    """Order by (start, end)."""
    return F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .when(a["end"] < b["end"], -1)
        .when(a["end"] > b["end"], 1)
        .otherwise(0),
    )


def merge_spans(spans: Column, label: str | None = None, touching: bool = True) -> Column:
    """Merge overlapping (and, by default, touching ``s <= e0``) intervals (V1).

    Result is sorted and disjoint.  The merged label is ``label`` if given, else the label of the
    first span of each island.
    """
    srt = sort_spans(F.coalesce(spans, empty_spans()))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (x["start"] <= last["end"]) if touching else (x["start"] < last["end"])
        merged = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], x["end"]).alias("end"),
            last["label"].alias("label"),
            last["src"].alias("src"),
        )
        return F.when(
            (F.size(acc) > 0) & joins,
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged)),
        ).otherwise(F.concat(acc, F.array(x)))

    out = F.aggregate(srt, empty_spans(), step)
    if label is not None:
        out = F.transform(out, lambda s: span(s["start"], s["end"], label, s["src"]))
    return out


def select_longest(spans: Column) -> Column:
    """Longest-first non-overlapping selection, ties by earlier start."""
    ordered = F.array_sort(
        F.coalesce(spans, empty_spans()),
        lambda a, b: F.when((a["end"] - a["start"]) > (b["end"] - b["start"]), -1)
        .when((a["end"] - a["start"]) < (b["end"] - b["start"]), 1)
        .when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .otherwise(0),
    )
    kept = F.aggregate(
        ordered,
        empty_spans(),
        lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return sort_spans(kept)


def select_first(spans: Column) -> Column:
    """Keep first, drop later overlaps, in (start, end) order (V9).  What is kept is sorted and disjoint, so the last one
    that is not empty decides about the next: the fold carries its end."""

    def step(acc, x):
        clear = acc["reach"].isNull() | (x["start"] >= acc["reach"])
        out = F.when(clear, F.concat(acc["out"], F.array(x))).otherwise(acc["out"])
        reach = F.when(clear & (x["end"] > x["start"]), x["end"]).otherwise(acc["reach"])
        return F.struct(out.alias("out"), reach.alias("reach"))

    start = F.struct(empty_spans().alias("out"), F.lit(None).cast("int").alias("reach"))
    return F.aggregate(sort_spans(F.coalesce(spans, empty_spans())), start, step, lambda acc: acc["out"])


def select_end_pointer(spans: Column) -> Column:
    """Sorted, keep if ``start >= last kept end``."""
    return F.aggregate(
        sort_spans(F.coalesce(spans, empty_spans())),
        empty_spans(),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x["start"] >= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )


def select_replace_longer(spans: Column) -> Column:
    """Left to right; an overlapping later span replaces the previous one if longer."""

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        over = (F.size(acc) > 0) & overlaps(x, last)
        longer = (x["end"] - x["start"]) > (last["end"] - last["start"])
        return (
            F.when(over & longer, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x)))
            .when(over, acc)
            .otherwise(F.concat(acc, F.array(x)))
        )

    return F.aggregate(sort_spans(F.coalesce(spans, empty_spans())), empty_spans(), step)


def surface(text: Column, s: Column, blocks: Column | None = None) -> Column:
    """Text covered by a span."""
    return sub(text, s["start"], s["end"] - s["start"], blocks)


def left_context(text: Column, start: Column, k: int, blocks: Column | None = None) -> Column:
    lo = F.greatest(start - k, F.lit(0))
    return sub(text, lo, start - lo, blocks)


def right_context(text: Column, end: Column, k: int, blocks: Column | None = None) -> Column:
    return sub(text, end, F.lit(k), blocks)


@lru_cache(maxsize=None)
def _cuts_udf():
    flatten, relist = _list_tools()

    def cut(text: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        n, first = flatten(starts)
        last = iter(sizes.flatten().to_pylist())
        out, lo = [], iter(first.to_pylist())
        for t, k in zip(text.to_pylist(), n.tolist()):
            for _ in range(k):
                a, ln = next(lo), next(last)
                out.append(None if t is None or a is None or ln is None else t[max(a, 0):max(a, 0) + max(ln, 0)])
        return relist(pa.array(out, pa.string()), n, starts)

    return F.arrow_udf(cut, "array<string>").asNondeterministic()


def cuts(text: Column, starts: Column, sizes: Column) -> Column:
    """``sub`` of a whole array of places, in Arrow batches: ``starts`` and ``sizes`` are arrays of one length."""
    return _cuts_udf()(text, starts.cast("array<int>"), sizes.cast("array<int>"))


def previous_ends(sp: Column) -> Column:
    """``[0, end_0, ..., end_{n-2}]``: the end of the previous span, aligned with ``sp``."""
    prev = F.concat(
        F.array(F.lit(0)),
        F.transform(F.slice(sp, 1, F.greatest(F.size(sp) - 1, F.lit(0))), lambda x: x["end"]),
    )
    # zip_with pads the shorter side with nulls, so an empty span list must give an empty array.
    return F.when(F.size(sp) > 0, prev).otherwise(F.array().cast("array<int>"))


def replace_spans(text: Column, spans: Column, tag: Column | str | None = None, tag_of=None,
                  blocks: Column | None = None) -> Column:
    """Rebuild ``text`` with each (sorted, disjoint) span replaced (M1).

    ``tag`` is a constant replacement; ``tag_of(span)`` a per-span replacement expression.
    Left to right: gaps and tags are joined once with ``array_join`` (linear).
    """
    sp = F.coalesce(spans, empty_spans())
    t = F.coalesce(text, F.lit(""))
    if tag_of is None:
        const = tag if isinstance(tag, Column) else F.lit(tag if tag is not None else "[X]")

        def tag_of(_s):
            return const

    def piece(x, prev_end):
        return F.array(sub(t, prev_end, x["start"] - prev_end, blocks), tag_of(x))

    last_end = F.coalesce(F.try_element_at(sp, F.lit(-1))["end"], F.lit(0))
    body = F.array_join(F.flatten(F.zip_with(sp, previous_ends(sp), piece)), "")
    out = F.concat(F.coalesce(body, F.lit("")), sub(t, last_end, text_length(t, blocks) - last_end, blocks))
    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(out)


def segments(text: Column, protected: Column, blocks: Column | None = None, tag_src: str | None = None) -> Column:
    """Split ``text`` into ``array<struct<txt, prot>>`` around sorted disjoint protected spans (M6).

    Open segments are masked, protected ones pass through byte for byte; no placeholder text is
    inserted, so a text that already holds a placeholder-like string is safe.
    """
    sp = F.coalesce(protected, empty_spans())
    t = F.coalesce(text, F.lit(""))

    def piece(x, prev_end):
        return F.array(
            F.struct(sub(t, prev_end, x["start"] - prev_end, blocks).alias("txt"), F.lit(False).alias("prot")),
            F.struct((F.when(x["src"] == tag_src, x["label"]).otherwise(sub(t, x["start"], x["end"] - x["start"], blocks))
                      if tag_src else sub(t, x["start"], x["end"] - x["start"], blocks)).alias("txt"),
                     F.lit(True).alias("prot")),
        )

    last_end = F.coalesce(F.try_element_at(sp, F.lit(-1))["end"], F.lit(0))
    tail = F.array(F.struct(sub(t, last_end, text_length(t, blocks) - last_end, blocks).alias("txt"),
                            F.lit(False).alias("prot")))
    return F.concat(F.flatten(F.zip_with(sp, previous_ends(sp), piece)), tail)


def join_segments(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: s["txt"]), "")


def clip_right(text: Column, s: Column, labels, stops, blocks: Column | None = None) -> Column:
    """New end: cut at the first stop token inside the span, unless the cut is at 0 (V4)."""
    frag = sub(text, s["start"], s["end"] - s["start"], blocks)
    cuts = [F.when(F.instr(frag, stop) > 0, F.instr(frag, stop) - 1) for stop in stops]
    c = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    new_end = F.when(c.isNull() | (c <= 0), s["end"]).otherwise(s["start"] + c)
    return F.when(s["label"].isin(list(labels)), new_end).otherwise(s["end"])


# Whitespace, Unicode separators, punctuation, zero-width space and BOM.
EDGE_CLASS = r"[\s\p{Z}\p{P}\x{200B}\x{FEFF}]"


def trim_span(text: Column, s: Column, edge_class: str = EDGE_CLASS, blocks: Column | None = None) -> Column:
    """Trim characters of ``edge_class`` from both span edges (V5); may give start == end."""
    frag = sub(text, s["start"], s["end"] - s["start"], blocks)
    lead = F.length(F.regexp_extract(frag, "(?U)^" + edge_class + "*", 0))
    rest = F.substring(frag, lead + 1, 2**31 - 1)
    trail = F.length(F.regexp_extract(rest, "(?U)" + edge_class + "*$", 0))
    ns = s["start"] + lead
    ne = F.greatest(ns, s["end"] - trail)
    return span(ns, ne, s["label"], s["src"])


def trim_whitespace(text: Column, s: Column, blocks: Column | None = None) -> Column:
    """Whitespace-only edge trim (V6): Python ``str.isspace`` characters."""
    from .patterns import PY_SPACE

    return trim_span(text, s, PY_SPACE, blocks)
