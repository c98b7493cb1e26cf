"""Findings of round 3 on time: array scans and cuts in Arrow batches, joined notes spread over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from velado.functions import spans as S
from velado.operators import entities as EN
from velado.operators import weak as WK


def test_scans_are_arrow_passes_and_keep_nulls(spark):
    rows = [(0, [3, 1, 2]), (1, []), (2, None), (3, [5, None, 4]), (4, [7])]
    df = spark.createDataFrame(rows, "k int, a array<int>")
    both = S.arrow_scans(S.arrow_scans(df, [("a", "before")]), [("a", "top")], "max", inclusive=True)
    got = {r["k"]: (r["before"], r["top"]) for r in both.collect()}
    assert got == {0: ([0, 3, 4], [3, 3, 3]), 1: ([], []), 2: (None, None), 3: ([0, 5, None], [5, 5, 5]), 4: ([0], [7])}
    assert "ArrowEvalPython" in both._jdf.queryExecution().executedPlan().toString()


def test_cuts_count_code_points(spark):
    df = spark.createDataFrame([(0, "añ\U0001f600bc", [0, 2, 4], [2, 2, 50]), (1, None, [0], [1]), (2, "", [], [])],
                               "k int, t string, s array<int>, n array<int>")
    got = {r["k"]: r["c"] for r in df.select("k", S.cuts(F.col("t"), F.col("s"), F.col("n")).alias("c")).collect()}
    assert got == {0: ["añ", "\U0001f600b", "c"], 1: [None], 2: []}


def test_contexts_are_cut_once_for_all_tokens(spark):
    docs = spark.createDataFrame([(1, "toma adiro con ñandú hoy"), (2, None), (3, "")], "d long, text string")
    arr = WK.weak_span_array(docs, "d", "text", window=5)
    got = {r["d"]: [(x["i"], x["left"], x["span"], x["right"], x["label"]) for x in r["weak"] or []] for r in arr.collect()}
    assert got[1][1] == (1, "toma ", "adiro", " con ", "DRUG") and got[1][3] == (3, " con ", "ñandú", " hoy", "OTHER")
    assert got[2] == [] and got[3] == []
    assert "ArrowEvalPython" in arr._jdf.queryExecution().executedPlan().toString()


def test_joined_notes_are_more_than_one_task(spark):
    docs = spark.range(50).withColumnRenamed("id", "k")
    joined = EN.spread_rows(docs.join(docs.withColumn("x", F.lit(1)), "k"), ["k"])
    want = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert joined.rdd.getNumPartitions() == want and joined.count() == 50
