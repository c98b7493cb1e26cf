"""Findings of round 3: streams of foldered tables, the split without moved rows, the balance over whole rows, wide scans."""

import hashlib
import os
from itertools import accumulate

from pyspark.sql import functions as F

from velado.functions import spans as S
from velado.operators import tokens as TK
from velado.operators import weak as WK
from velado.plans import catalog
from velado.session import ensure_checkpoint_dir


def test_mask_stream_reads_a_folder_of_files(spark, tmp_path):
    docs = [(i, f"Fecha 01/02/202{i} y DNI 1234567{i}Z", "es", "x", 30) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["mask_stream"](spark, str(tmp_path))
    want = catalog.queries()["mask_documents"](spark, str(tmp_path)).select(got.columns)
    assert got.count() == 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _stored(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names)


def test_stratified_split_stores_rows_small_and_cuts_exactly(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 4 > 0, "a").alias("label"))
    before = _stored(spark)
    out = WK.stratified_split(rows, "label", ["id"], task_rows=3)
    n = {(r["label"], r["split"]): r["n"] for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert n == {("a", "test"): 2250, ("a", "train"): 12750, (None, "test"): 750, (None, "train"): 4250}
    assert _stored(spark) - before < 20 * 20_000
    h = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    lowest = sorted((i for i in range(20_000) if i % 4 == 0), key=h)[:750]
    assert {r[0] for r in out.where("label IS NULL AND split = 'test'").select("id").collect()} == set(lowest)


def test_balance_hashes_whole_rows_and_counts_copies(spark):
    text = "uno dos tres cuatro cinco seis siete ocho"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "nueve diez")], "doc_id long, text string")
    got = [(r.doc_id, r.i, r.left, r.span, r.right) for r in WK.balanced_spans(docs, "doc_id", "text").collect()]
    every = []
    for key, t in [(1, text), (1, text), (2, "nueve diez")]:
        at = 0
        for i, tok in enumerate(t.split()):
            every.append((key, i, t[max(0, at - 50):at], tok, t[at + len(tok):at + len(tok) + 50]))
            at += len(tok) + 1
    rank = lambda r: hashlib.md5("|".join(map(str, ("42", *r))).encode()).hexdigest()
    assert sorted(got) == sorted(sorted(every, key=rank)[:9])


def test_scan_has_three_levels_and_tokens_are_zipped(spark):
    values = [[(7 * i) % 11 for i in range(n)] for n in (0, 1, 4, 5, 65, 1000)]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "k int, a array<int>")
    both = S.scan_column(S.scan_column(df, "a", "before"), "a", "top", "max", inclusive=True)
    for r in both.collect():
        assert r.before == [0, *accumulate(r.a)][:len(r.a)] and r.top == list(accumulate(r.a, max))
    toks = TK.with_tokens(spark.createDataFrame([("a-b 5.3",), (None,)], "text string"), "text", "toks")
    assert [[tuple(t) for t in r.toks] for r in toks.collect()] == [[(0, "a-b", 0, 3), (1, "5.3", 4, 7)], []]
    plan = toks._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in plan and "CBRT" in plan.upper()
