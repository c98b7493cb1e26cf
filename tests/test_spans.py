"""Span algebra against brute force in plain Python."""

import random
import re

from pyspark.sql import functions as F

from velado.functions import patterns as P
from velado.functions import spans as S
from velado.operators import evaluate as EV


def _py_merge(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _py_iou(gold, pred, thr=0.5):
    used, tp = set(), 0
    for gs, ge in gold:
        best, bj = -1.0, -1
        for j, (ps, pe) in enumerate(pred):
            if j in used:
                continue
            inter = max(0, min(ge, pe) - max(gs, ps))
            uni = (ge - gs) + (pe - ps) - inter
            v = inter / uni if uni else 0.0
            if v > best:
                best, bj = v, j
        if best >= thr:
            tp += 1
            used.add(bj)
    return tp, len(pred) - tp, len(gold) - tp


def test_offsets_are_code_points(spark):
    texts = ["a😀b 12 x 345", "Málaga 07/03/2024 y 😀😀 88", "", None, "sin cifras"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = S.with_regex_spans(df, "t", r"(?U)\d+", "sp", with_surface=True).orderBy("id").collect()
    for row, t in zip(out, texts):
        want = [(m.start(), m.end(), m.group(0)) for m in re.finditer(r"\d+", t or "")]
        got = [(x["start"], x["end"], x["surface"]) for x in row["sp"]]
        assert got == want


def test_many_matches_blockwise_scan(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "id int, t string")
    row = S.with_regex_spans(df, "t", r"(?U)\w+", "sp").collect()[0]
    want = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    assert [(x["start"], x["end"]) for x in row["sp"]] == want


def test_merge_and_selection_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for doc in range(40):
        sp = []
        for _ in range(rnd.randint(0, 12)):
            s = rnd.randint(0, 60)
            sp.append((s, s + rnd.randint(1, 9), rnd.choice("AB"), None))
        rows.append((doc, sp))
    df = spark.createDataFrame(rows, f"doc int, sp {S.SPANS_TYPE}")
    out = df.select("doc", S.merge_spans(F.col("sp")).alias("m"), S.select_first(F.col("sp")).alias("f"),
                    S.select_longest(F.col("sp")).alias("l"), S.select_end_pointer(F.col("sp")).alias("p")).collect()
    by = {r["doc"]: r for r in out}
    for doc, sp in rows:
        se = [(s, e) for s, e, _, _ in sp]
        assert [(x["start"], x["end"]) for x in by[doc]["m"]] == _py_merge(se)
        keep = []
        for s, e in sorted(se):
            if not any(s < ke and ks < e for ks, ke in keep):
                keep.append((s, e))
        assert sorted((x["start"], x["end"]) for x in by[doc]["f"]) == sorted(keep)
        longest = []
        for s, e in sorted(se, key=lambda x: (-(x[1] - x[0]), x[0])):
            if not any(s < ke and ks < e for ks, ke in longest):
                longest.append((s, e))
        assert sorted((x["start"], x["end"]) for x in by[doc]["l"]) == sorted(longest)
        ptr, last = [], -1
        for s, e in sorted(se):
            if s >= last:
                ptr.append((s, e))
                last = e
        assert [(x["start"], x["end"]) for x in by[doc]["p"]] == ptr


def test_iou_greedy_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for doc in range(60):
        g = _py_merge([(s, s + rnd.randint(1, 8)) for s in rnd.sample(range(80), rnd.randint(0, 6))])
        p = _py_merge([(s, s + rnd.randint(1, 8)) for s in rnd.sample(range(80), rnd.randint(0, 6))])
        rows.append((doc, [(a, b, "X", None) for a, b in g], [(a, b, "X", None) for a, b in p]))
    df = spark.createDataFrame(rows, f"doc int, g {S.SPANS_TYPE}, p {S.SPANS_TYPE}")
    got = {r["doc"]: (r["c"]["tp"], r["c"]["fp"], r["c"]["fn"])
           for r in df.select("doc", EV.iou_counts(F.col("g"), F.col("p")).alias("c")).collect()}
    for doc, g, p in rows:
        assert got[doc] == _py_iou([(a, b) for a, b, _, _ in g], [(a, b) for a, b, _, _ in p])


def test_replace_and_segments_keep_text(spark):
    text = "abc __PROT0__ 12 def 😀 34"
    sp = [(4, 13, "P", None), (17, 20, "X", None)]
    df = spark.createDataFrame([(text, sp)], f"t string, sp {S.SPANS_TYPE}")
    df, blk = S.with_blocks(df, "t")
    r = df.select(S.replace_spans(F.col("t"), F.col("sp"), "[X]", blocks=F.col(blk)).alias("r"),
                  S.join_segments(S.segments(F.col("t"), F.col("sp"), F.col(blk))).alias("j")).collect()[0]
    assert r["r"] == "abc [X] 12 [X] 😀 34"
    assert r["j"] == text


def test_alternation_longest_first():
    pat = P.alternation(["a", "abc", "ab"])
    assert pat.index("abc") < pat.index("\\Qab\\E")


def test_bucketed_overlap_join_matches_nested_loop(spark):
    from velado.operators import spanops as SO

    rnd = random.Random(11)
    spans, toks = [], []
    for doc in range(5):
        for _ in range(30):
            s = rnd.randint(0, 400)
            spans.append((doc, s, s + rnd.randint(1, 150)))
        pos = 0
        while pos < 560:
            ln = rnd.randint(1, 9)
            toks.append((doc, pos, pos + ln))
            pos += ln + rnd.randint(1, 3)
    sdf = spark.createDataFrame(spans, "doc int, start int, end int").distinct()
    tdf = spark.createDataFrame(toks, "doc int, start int, end int")
    got = sorted((r["doc"], r["start"], r["end"], r["ts"], r["te"])
                 for r in SO.bucketed_overlap_join(sdf, tdf, ["doc"], width=16, how="inner").collect())
    want = sorted({(d, s, e, ts, te) for d, s, e in spans for d2, ts, te in toks if d == d2 and ts < e and s < te})
    assert got == want


def _iou_rows(spark, gold, pred, thr=0.5):
    schema = "doc int, start int, end int, text string"
    g, p = (spark.createDataFrame([(*r, "x") for r in rows], schema) for rows in (gold, pred))
    return {r["doc"]: (r["tp"], r["fp"], r["fn"]) for r in EV.iou_counts_rows(g, p, ["doc"], thr).collect()}


def test_iou_rows_match_brute_force(spark):
    """Dense, repeated and nested spans in any order of rows, at several thresholds."""
    rnd = random.Random(21)
    for thr in (0.3, 0.5, 0.8, 1.0):
        gold, pred = [], []
        for doc in range(25):
            for side in (gold, pred):
                for _ in range(rnd.randint(0, 40)):
                    s = rnd.choice([rnd.randint(0, 60), 4096 + rnd.randint(-20, 20), rnd.randint(0, 9000)])
                    side.extend([(doc, s, s + rnd.choice([1, 2, 3, 5, 9, 17, 40]))] * rnd.choice([1, 1, 1, 3]))
        rnd.shuffle(gold)
        rnd.shuffle(pred)
        got = _iou_rows(spark, gold, pred, thr)
        for doc in range(25):
            g, p = (sorted((s, e) for d, s, e in side if d == doc) for side in (gold, pred))
            if g or p:
                assert got[doc] == _py_iou(g, p, thr), (thr, doc)
            else:
                assert doc not in got


def test_iou_rows_of_one_long_document(spark):
    """One chain of overlaps through a whole document, longer than an Arrow batch, and thousands of equal spans."""
    gold = [(1, 10 * i, 10 * i + 14) for i in range(12000)] + [(2, 5, 9)] * 3000
    pred = [(1, 10 * i + 2, 10 * i + 15) for i in range(12000)] + [(2, 5, 9)] * 2000 + [(2, 5, 10)] * 500
    assert _iou_rows(spark, gold, pred) == {1: (12000, 0, 0), 2: (2500, 0, 500)}


def test_iou_rows_nulls_and_empty(spark):
    got = _iou_rows(spark, [(1, None, 4), (1, 3, 3), (None, 1, 2), (2, 0, 4)], [(1, 3, 3), (1, 2, None), (3, 1, 5)])
    assert got == {1: (0, 1, 1), 2: (0, 0, 1), 3: (0, 1, 0)}
    assert _iou_rows(spark, [], []) == {}


def test_iou_rows_make_their_pairs_once(spark):
    """The pairs of the cells are joined and shuffled once, though runs use them twice."""
    schema = "doc int, start int, end int"
    g, p = (spark.createDataFrame([(d, 10 * i, 10 * i + w) for d in range(20) for i in range(30)], schema) for w in (8, 9))
    found = EV.iou_matches(g, p, ["doc"])
    assert len(found.collect()) == 600
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in plan.splitlines() if "Join " in x and "__c#" in x]) == 1


def test_overlap_runs_across_blocks(spark):
    from velado.operators import spanops as SO

    rnd = random.Random(4)
    rows = [(d, s, s + rnd.randint(1, 30)) for d in range(4) for s in (rnd.randint(0, 2000) for _ in range(120))]
    got = SO.overlap_runs(spark.createDataFrame(rows, "doc int, a int, b int"), ["doc"], "a", "b", block=16).collect()
    for doc in range(4):
        run, reach, want = None, -1, {}
        for a, b in sorted((a, b) for d, a, b in rows if d == doc):
            if a >= reach:
                run = a
            reach = max(reach, b)
            want[a] = run
        assert all(r["run"] == want[r["a"]] for r in got if r["doc"] == doc)
    assert len(got) == len(rows)
