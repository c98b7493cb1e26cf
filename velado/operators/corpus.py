"""Stand-off annotated corpora as DataFrames.

Documents are rows ``(split, stem, text)``; annotation files are rows ``(split, stem, ann)``.
Annotation lines are parsed with built-in string functions (``split``, ``regexp_extract_all``,
``try_cast``) into span arrays or one row per span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S



def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``root/<split>/[brat/]*.txt`` and same-stem ``.ann`` as ``split, stem, text, ann``.

    Whole-file reads with the file path from ``_metadata``; the ``brat/`` subfolder wins for a
    split that has one.  Missing ``.ann`` means no entities (left join).
    """
    def files(ext):
        df = spark.read.text(root, wholetext=True, pathGlobFilter=f"*.{ext}", recursiveFileLookup=True)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return df.select(
            F.regexp_extract(path, r"/([^/]+)/(?:brat/)?[^/]+$", 1).alias("split"),
            F.regexp_extract(path, r"/([^/]+)\.[^./]+$", 1).alias("stem"),
            path.contains("/brat/").alias("in_brat"),
            F.col("value").alias(ext),
        )

    txt, ann = files("txt"), files("ann")
    has_brat = txt.groupBy("split").agg(F.max("in_brat").alias("split_has_brat"))
    txt = txt.join(F.broadcast(has_brat), "split").filter(F.col("in_brat") == F.col("split_has_brat"))
    docs = txt.select("split", "stem", "in_brat", "txt")
    return docs.join(ann.select("split", "stem", "in_brat", "ann"), ["split", "stem", "in_brat"], "left") \
        .select("split", "stem", F.col("txt").alias("text"), "ann")


def without_annotations(texts: DataFrame, files: DataFrame) -> DataFrame:
    """``split, stem, reason`` of the texts that have no annotation file (J2).  An empty file is a file.  Only the keys of
    the files take part; a file that occurs twice, or has no text, changes nothing."""
    keys = ["split", "stem"]
    return texts.select(*keys).join(files.select(*keys), keys, "left_anti").withColumn("reason", F.lit("NO_ANN"))


def parse_ann(ann: Column, text: Column, lenient: bool = False, only_label: str | None = None,
              file_order: bool = False) -> Column:
    """Annotation text -> ``array<span>`` (S5; S6 when ``lenient``; S7 with ``only_label``).

    Keeps ``T`` lines of the form ``T1<TAB>LABEL s e[;s e]<TAB>surface``; discontinuous segments
    become separate spans; malformed lines and segments are skipped; spans must satisfy
    ``0 <= s < e <= len(text)``.  The lenient form also accepts ``T1 LABEL s e ...`` separated by
    spaces and keeps only the first segment.  Spans are sorted by place, or stay in ``file_order``.
    """
    lines = F.transform(F.split(F.coalesce(ann, F.lit("")), r"\r?\n", -1), lambda x: F.trim(x))
    n = F.length(F.coalesce(text, F.lit("")))

    def head(line):
        tab = F.split(line, "\t", 3)
        strict = F.when(line.rlike(r"^T[^\t]*\t"), F.get(tab, 1))
        if not lenient:
            return strict
        loose = F.regexp_extract(line, r"^T\S*\s+(\S+\s+\d+\s+\d+)", 1)
        return F.coalesce(strict, F.when(loose != "", loose))

    def segs(line):
        h = head(line)
        parts = F.split(F.trim(h), r"\s+", 2)
        label = F.get(parts, 0)
        coords = F.coalesce(F.get(parts, 1), F.lit(""))
        seg_list = F.split(coords, ";", -1)
        if lenient:
            seg_list = F.slice(seg_list, 1, 1)

        def one(seg):
            xy = F.split(F.trim(seg), r"\s+", -1)
            ok = F.size(xy) == 2
            s = F.when(ok, F.get(xy, 0).try_cast("int"))
            e = F.when(ok, F.get(xy, 1).try_cast("int"))
            return S.span(s, e, label, F.lit("ann"))

        valid = F.filter(F.transform(F.filter(seg_list, lambda x: F.trim(x) != ""), one),
                         lambda x: x["start"].isNotNull() & x["end"].isNotNull()
                         & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= n))
        return F.when(h.isNotNull() & (F.trim(h) != "") & line.startswith("T"), valid).otherwise(S.empty_spans())

    out = F.flatten(F.transform(lines, segs))
    if only_label:
        out = F.filter(out, lambda x: x["label"] == only_label)
    return out if file_order else S.sort_spans(out)


def ann_lines(spans: Column, text: Column, blocks: Column | None = None) -> Column:
    """Annotation text ``T{i}\\tLABEL s e\\tsurface`` numbered per document from 1."""
    def line(x, i):
        surf = F.regexp_replace(S.surface(text, x, blocks), r"[\t\r\n]", " ")
        return F.format_string("T%d\t%s %d %d\t%s", i + 1, x["label"], x["start"], x["end"], surf)

    return F.array_join(F.transform(S.sort_spans(spans), line), "\n")


def fix_ann_line(line: Column, label: str = P.DRUG_ANN_LABEL) -> Column:
    """``struct<lines, parsed>``: an annotation line with several annotations and no tab, split into proper lines.

    Only a line that starts with ``T`` and holds no tab is looked at; any other stays as it is (``parsed`` null).  One
    that holds no annotation of ``label`` stays as well, with ``parsed`` false.
    """
    pat = F.lit(P.untabbed_annotations(label))
    part = lambda k: F.regexp_extract_all(line, pat, F.lit(k))
    z = F.arrays_zip(part(1).alias("i"), part(2).alias("s"), part(3).alias("e"), part(4).alias("t"))
    fixed = F.transform(z, lambda r: F.format_string(f"%s\t{label} %s %s\t%s", r["i"], r["s"], r["e"], F.trim(r["t"])))
    ours = line.startswith("T") & ~F.contains(line, F.lit("\t"))
    n = F.when(ours, F.size(z))
    return F.struct(F.when(n > 0, fixed).otherwise(F.array(line)).alias("lines"), (n > 0).alias("parsed"))


REASONS = ("empty-after-normalize", "isspace-edge", "space/punct-edge", "strip-differs")


def check_text(frag: Column) -> Column:
    """The text whose edges are checked: NBSP is a space, zero-width space and BOM are left out."""
    return F.translate(frag, "\u00a0\u200b\ufeff", " ")


def edge_reason(frag: Column) -> Column:
    """Reject reason for a span fragment (V8), or null when the edges are clean.

    Whitespace is Python's ``str.isspace`` set, spelled out.
    """
    return checked_edges(check_text(frag))


def checked_edges(chk: Column) -> Column:
    """``edge_reason`` of a check text: a column of its own (``check_text``) is computed once, and is asked for five times."""
    first, last = F.substring(chk, 1, 1), F.substring(chk, -1, 1)
    sp = P.PY_SPACE
    space_punct = "^(?:" + sp + r"|[\p{Z}\p{P}\x{200B}\x{FEFF}])$"
    return (
        F.when(chk == "", F.lit(REASONS[0]))
        .when(first.rlike("^" + sp + "$") | last.rlike("^" + sp + "$"), F.lit(REASONS[1]))
        .when(first.rlike(space_punct) | last.rlike(space_punct), F.lit(REASONS[2]))
        .when(chk != F.regexp_replace(chk, "^" + sp + "+|" + sp + "+$", ""), F.lit(REASONS[3]))
    )


def first_by_label(span_rows: DataFrame, labels, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Wide table (A8): first surface per label (by ``order``, the span's place in its file) as columns, plus the sorted
    distinct labels joined by ``,``; missing values are ``''``.

    The pivot is written as conditional aggregates (what ``pivot`` expands to), so the label list
    and every label column come from one grouped aggregation: one shuffle on ``key``, no join.
    """
    aggs = [F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels_present")]
    for lab in labels:
        aggs.append(F.coalesce(F.min_by("surface", F.when(F.col("label") == lab, F.col(order))), F.lit("")).alias(lab))
    return span_rows.groupBy(key).agg(*aggs)


#: Reasons of lines and segments that give no span at all, before the edges are looked at.
NOT_PARSED, OUT_OF_RANGE = "malformed", "out-of-range"


def checked_lines(docs: DataFrame, context: int = 30) -> DataFrame:
    """Every annotated segment of ``docs`` (``split, stem, text, ann``) with where it stands and why it is rejected.

    Columns ``split, file, line_no, label, start, end, reason, first, last, frag, context``; ``file`` is the annotation
    file's name, ``line_no`` counts from 1, ``first`` and ``last`` are the code points of the edges, and ``reason`` is null
    for a good span.  Lines that do not start with ``T`` (notes, relations) are no annotations.  Both outcomes come from
    one pass: store the rows once, and split them by ``reason``.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d, blk = S.with_blocks(docs.select("split", "stem", t.alias("text"), F.split(F.coalesce("ann", F.lit("")), r"\r?\n", -1).alias("lines")), "text")
    d = d.withColumn("size", F.length("text"))
    lines = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    named = S.explode_rows(d.withColumn("l", lines), F.filter("l", lambda x: x["line"].startswith("T")),
                           ["split", F.concat("stem", F.lit(".ann")).alias("file"), "text", blk, "size"], "l").select("*", "l.*").drop("l")
    part = F.regexp_extract_all("line", F.lit(P.ANN_FIELDS), F.lit(1))
    head = F.get(part, F.lit(0))
    segs = F.split(F.regexp_extract("line", P.ANN_FIELDS, 2), r"\s*;\s*")
    rows = named.withColumn("label", head).withColumn("seg", F.explode(F.when(F.col("label").isNull(), F.array(F.lit(""))).otherwise(segs)))
    at = lambda i: F.get(F.split("seg", r"\s+"), F.lit(i)).try_cast("int")
    rows = rows.withColumn("start", at(0)).withColumn("end", at(1))
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size"))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    cut = lambda a, b: S.sub(F.col("text"), a, b - a, F.col(blk))
    rows = rows.withColumn("frag", F.when(F.col("inside"), cut(F.col("start"), F.col("end"))))
    rows = rows.withColumn("chk", check_text(F.col("frag")))
    low = F.greatest(F.col("start") - context, F.lit(0))
    point = lambda c: F.format_string("U+%04X", F.ascii(c))
    reason = F.when(F.col("label").isNull(), NOT_PARSED).when(~F.col("inside"), OUT_OF_RANGE).otherwise(checked_edges(F.col("chk")))
    return rows.select("split", "file", "line_no", "label", "start", "end", reason.alias("reason"),
                       F.when(F.col("inside"), point(F.substring("frag", 1, 1))).alias("first"), F.when(F.col("inside"), point(F.substring("frag", -1, 1))).alias("last"),
                       "frag", F.when(F.col("inside"), cut(low, F.col("end") + context)).alias("context"))
