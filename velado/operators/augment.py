"""Template augmentation (T11): one medication sentence per input row, with entity offsets.

Choices are repeatable md5 hashes of ``(seed, key)`` (the reference is unseeded); drugs are drawn
without replacement by hash rank; offsets come from the position of each placeholder as it is
filled left to right, so ``Sintrom`` is never found inside ``Sintrom®``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from . import corpus as C


def _arr(values):
    return F.array(*[F.lit(v) for v in values])


def _pick(values, h: Column) -> Column:
    return F.element_at(_arr(values), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def templated(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``synth_text``, ``synth_spans`` (label FARMACO) and ``synth_ann`` for each row."""
    def h(tag):
        # First 32 bits of md5(seed|tag|key) as a non-negative integer.
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(key).cast("string"))), 1, 8),
                      16, 10).cast("long")

    u = F.pmod(h("k"), F.lit(100))
    k = F.when(u < P.TEMPLATE_MIX[0], 1).when(u < P.TEMPLATE_MIX[0] + P.TEMPLATE_MIX[1], 2).otherwise(3)
    tmpl = F.when(k == 1, _pick(P.TEMPLATES_1, h("t"))).when(k == 2, _pick(P.TEMPLATES_2, h("t"))) \
        .otherwise(_pick(P.TEMPLATES_3, h("t")))
    ranked = F.array_sort(F.transform(_arr(P.TEMPLATE_DRUGS), lambda d: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), d)).alias("r"), d.alias("d"))))
    df = df.withColumn("__k", k).withColumn("__drugs", F.transform(F.slice(ranked, 1, k), lambda x: x["d"]))
    text = tmpl
    for name, values in (("{dx}", P.TEMPLATE_DIAGNOSES), ("{motivo}", P.TEMPLATE_REASONS),
                         ("{dosis}", P.TEMPLATE_DOSES), ("{via}", P.TEMPLATE_ROUTES)):
        text = F.replace(text, F.lit(name), _pick(values, h(name)))
    df = df.withColumn("__t0", text)
    spans = []
    cur = "__t0"
    for i in (1, 2, 3):
        ph = F.lit("{f%d}" % i)
        drug = F.get(F.col("__drugs"), i - 1)
        st = F.instr(F.col(cur), ph) - 1
        df = df.withColumn(f"__s{i}", F.when(st >= 0, S.span(st, st + F.length(drug), "FARMACO", F.lit("template"))))
        df = df.withColumn(f"__t{i}", F.when(st >= 0, F.replace(F.col(cur), ph, drug)).otherwise(F.col(cur)))
        spans.append(f"__s{i}")
        cur = f"__t{i}"
    df = df.withColumn("synth_text", F.col(cur))
    df = df.withColumn("synth_spans", F.filter(F.array(*[F.col(s) for s in spans]), lambda x: x.isNotNull()))
    df = df.withColumn("synth_ann", C.ann_lines(F.col("synth_spans"), F.col("synth_text")))
    return df.drop("__k", "__drugs", "__t0", *spans, "__t1", "__t2", "__t3")
