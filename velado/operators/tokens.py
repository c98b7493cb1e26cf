"""Tokens, context features, character n-grams, BIO tags and overlapping chunks.

Tokens stay in the document row as ``array<struct<i, tok, start, end>>``: context windows are
``get(tokens, i +- k)`` inside the row, so W1 needs no shuffle; the row form with ``lag``/``lead``
(``context_rows``) is there for tables that are already one row per token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S

TOKEN_RE = P.cs(P.TOKEN_PATTERN)


def with_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Tokenise with ``\\w+([\\-\\.]\\w+)*`` (Unicode), keeping code-point offsets."""
    tmp = S._tmp("tokspans")
    df = S.with_regex_spans(df, text, TOKEN_RE, tmp, with_surface=True, scans=S.scan_columns)
    x = F.col(tmp)
    toks = F.arrays_zip(S.seq0(F.size(x)).alias("i"), x["surface"].alias("tok"), x["start"].alias("start"), x["end"].alias("end"))
    return df.withColumn(out, toks).drop(tmp)


def _nb(toks: Column, i: Column, k: int) -> Column:
    """Lower-cased neighbour token at offset ``k`` ('' outside the document)."""
    j = i + k
    return F.when((j >= 0) & (j < F.size(toks)), F.lower(F.get(toks, j)["tok"])).otherwise(F.lit(""))


def context_features(toks_col: str, lexicon_col: str | None = None, of: str | None = None) -> Column:
    """Per token: prev/next 1..2, unit nearby, digit in a neighbour, capitalised, in lexicon.

    ``toks_col`` must be a materialised column (it is indexed inside the lambda).  ``of`` names an array of some of its
    tokens, if not all are wanted.
    """
    toks = F.col(toks_col)
    units = F.array(*[F.lit(u) for u in P.FEATURE_UNITS])

    def feat(t):
        i = t["i"]
        p1, n1, p2, n2 = _nb(toks, i, -1), _nb(toks, i, 1), _nb(toks, i, -2), _nb(toks, i, 2)
        fields = [
            t["i"].alias("i"), t["tok"].alias("tok"), t["start"].alias("start"), t["end"].alias("end"),
            p1.alias("prev1"), n1.alias("next1"), p2.alias("prev2"), n2.alias("next2"),
            (F.array_contains(units, n1) | F.array_contains(units, p1) | F.array_contains(units, n2)
             | F.array_contains(units, p2)).cast("int").alias("ctx_has_unit"),
            (n1.rlike(r"(?U)\d") | p1.rlike(r"(?U)\d")).cast("int").alias("ctx_has_number"),
            F.substring(t["tok"], 1, 1).rlike(r"^\p{Lu}").cast("int").alias("is_capitalized"),
        ]
        if lexicon_col:
            fields.append(F.array_contains(F.col(lexicon_col), F.lower(t["tok"])).cast("int").alias("in_lex"))
        return F.struct(*fields)

    return S.pinned(toks_col, F.transform(of or toks_col, feat))


def char_ngrams(tok: Column, sizes=(3, 4, 5)) -> Column:
    """Distinct lower-case character n-grams of a token as ``char{k}=...`` features."""
    s = F.lower(tok)
    def grams(k):
        return F.transform(S.seq0(F.length(s) - k + 1), lambda j: F.concat(F.lit(f"char{k}="), F.substring(s, j + 1, k)))

    per_k = [grams(k) for k in sizes]
    return F.array_distinct(F.concat(*per_k))


def feature_strings(feat: Column, lex: bool = True) -> Column:
    """All features of a token as ``name=value`` strings for hashing (T4 -> L1)."""
    named = [
        F.concat(F.lit("prev1="), feat["prev1"]), F.concat(F.lit("next1="), feat["next1"]),
        F.concat(F.lit("prev2="), feat["prev2"]), F.concat(F.lit("next2="), feat["next2"]),
        F.concat(F.lit("ctx_has_unit="), feat["ctx_has_unit"].cast("string")),
        F.concat(F.lit("ctx_has_number="), feat["ctx_has_number"].cast("string")),
        F.concat(F.lit("is_capitalized="), feat["is_capitalized"].cast("string")),
    ]
    if lex:
        named.append(F.concat(F.lit("in_drug_lex="), feat["in_lex"].cast("string")))
    return F.concat(char_ngrams(feat["tok"]), F.array(*named))


def context_rows(tokens: DataFrame, keys) -> DataFrame:
    """Row form of W1: ``lag``/``lead`` over ``partition by keys order by i`` (one shuffle on keys)."""
    w = Window.partitionBy(*keys).orderBy("i")
    lt = F.lower(F.col("tok"))
    return tokens.select(
        *keys, "i", "tok",
        F.lag(lt, 1, "").over(w).alias("prev1"), F.lead(lt, 1, "").over(w).alias("next1"),
        F.lag(lt, 2, "").over(w).alias("prev2"), F.lead(lt, 2, "").over(w).alias("next2"),
    )


def first_hits(toks_col: str, spans_col: str) -> Column:
    """Per token, the first span (in span order) it overlaps, or null (J4 inside the row)."""
    toks, sp = F.col(toks_col), F.col(spans_col)
    return S.pinned(spans_col, F.transform(
        toks, lambda t: F.get(F.filter(sp, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])), 0)))


def bio_from_hits(hits_col: str) -> Column:
    """``B-x`` / ``I-x`` / ``O`` per token from its first-hit span.

    ``I`` when the previous token's first hit is the same span, else ``B``: with sorted, disjoint
    spans this is "first overlapping token B, the rest I".  ``hits_col`` must be materialised.
    """
    h = F.col(hits_col)

    def tag(x, i):
        prev = F.get(h, i - 1)
        same = (i > 0) & prev.isNotNull() & (prev["start"] == x["start"]) & (prev["end"] == x["end"])
        return F.when(x.isNull(), F.lit("O")).when(same, F.concat(F.lit("I-"), x["label"])).otherwise(
            F.concat(F.lit("B-"), x["label"]))

    return S.pinned(hits_col, F.transform(h, tag))


def with_bio_tags(df: DataFrame, toks_col: str, spans_col: str, out: str) -> DataFrame:
    hits = S._tmp("hits")
    return df.withColumn(hits, first_hits(toks_col, spans_col)).withColumn(out, bio_from_hits(hits)).drop(hits)


def tags_by_place(tags_col: str) -> Column:
    """Tags of a document's tokens as ``(i, label)``."""
    return S.pinned(tags_col, F.transform(tags_col, lambda y, i: F.struct(i.alias("i"), y.alias("label"))))


def chunk_starts(n: Column, max_len: int = 256, stride: int = 128) -> Column:
    """Token start index of each overlapping window of ``max_len`` tokens, overlap ``stride``."""
    step = max_len - stride
    last = F.greatest(F.lit(0), F.ceil((n - max_len) / step)).cast("int")
    return F.transform(S.seq0(last + 1), lambda k: k * step)


def chunk_tags(n: Column, starts: Column, tags_of, max_len: int = 256) -> Column:
    """``array<struct<start, tags>>``: ``tags_of(start, length)`` for every chunk of a document of ``n`` tokens."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), tags_of(s, F.least(F.lit(max_len), n - s)).alias("tags")))


def stitch_chunks(n: Column, chunks: Column, max_len: int = 256, stride: int = 128) -> Column:
    """One tag for each of ``n`` tokens from the tags of overlapping chunks (W3): a token takes that of the chunk in which
    it stands farthest from the nearer end, the earlier chunk on a tie.  ``chunks`` start at multiples of the step and all but
    the last are full, as ``chunk_starts`` gives them.  So the tokens of a chunk are a run: it ends half-way between the
    start of the next chunk and its own end, and each chunk gives its run as a whole.
    """
    step = max_len - stride

    def run(c, k):
        first = F.when(k == 0, F.lit(0)).otherwise(F.floor((2 * k * step - step + max_len - 1) / 2).cast("int") + 1)
        last = F.when(k == F.size(chunks) - 1, n - 1).otherwise(F.floor((2 * k * step + step + max_len - 1) / 2).cast("int"))
        return F.slice(c["tags"], first - c["start"] + 1, F.greatest(last - first + 1, F.lit(0)))

    return F.flatten(F.transform(chunks, run))


def label_ids(tags: Column, labels) -> Column:
    """Ids of BIO tags by their place in ``labels`` (``O`` first); a tag that is not among them counts as ``O``."""
    ids = F.create_map(*[x for i, t in enumerate(labels) for x in (F.lit(t), F.lit(i))])
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(list(labels).index("O"))))


def bio_label_list(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """``O`` then ``B-x``, ``I-x`` for each distinct label in sorted order, with ids.

    Distinct labels are few; ids come from ``row_number`` over the sorted distinct labels.
    """
    from pyspark.sql import Window as W

    d = labels.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    d = d.withColumn("k", F.row_number().over(W.orderBy(label_col)) - 1)
    bi = d.select(F.explode(F.array(
        F.struct(F.concat(F.lit("B-"), F.col(label_col)).alias("tag"), (2 * F.col("k") + 1).alias("id")),
        F.struct(F.concat(F.lit("I-"), F.col(label_col)).alias("tag"), (2 * F.col("k") + 2).alias("id")))).alias("x")).select("x.*")
    o = labels.sparkSession.createDataFrame([("O", 0)], "tag string, id int")
    return o.unionByName(bi.select("tag", F.col("id").cast("int").alias("id")))


def ngrams(toks_col: str, n: int) -> Column:
    """Lower-case token n-grams joined by one space (D9 phrase keys)."""
    toks = F.col(toks_col)
    return S.pinned(toks_col, F.transform(
        S.seq0(F.size(toks) - n + 1),
        lambda i: F.lower(F.array_join(F.transform(F.slice(toks, i + 1, n), lambda t: t["tok"]), " "))))
