"""Model vetoes, bundles, lexicon tables, splits, audits, chunks and corpus checks on small fixtures."""

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from velado.functions import patterns as P
from velado.functions import spans as S
from velado.operators import audit as AU
from velado.operators import corpus as C
from velado.operators import entities as EN
from velado.operators import evaluate as EV
from velado.operators import lexicon as LX
from velado.operators import mask as M
from velado.operators import ml as ML
from velado.operators import policy as PO
from velado.operators import tokens as TK
from velado.operators import weak as WK
from velado.profile import default_profile
from velado.session import ensure_checkpoint_dir
from velado.streaming import mask_stream as MS


def brute_spans(text, terms, wide):
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    out = set()
    for term in {t.strip().lower() for t in terms}:
        tw = re.findall(r"\w+", term)
        if not tw or not re.fullmatch(r"\w(?:.*\w)?", term, re.S):
            continue
        gaps = re.split(r"\w+", term)[1:-1]
        for i in range(len(words) - len(tw) + 1):
            run = words[i : i + len(tw)]
            if [text[a:b].lower() for a, b in run] != tw:
                continue
            between = [text[a[1] : b[0]] for a, b in zip(run, run[1:])]
            if wide:
                ok = all(re.fullmatch(r"(?:\s+|-)+", x) if re.fullmatch(r"\s+", g) else x == g for g, x in zip(gaps, between))
            else:
                ok = between == gaps
            if ok:
                end = run[-1][1]
                if wide and text[end : end + 1] in ("®", "™") and text[end : end + 1] and not re.match(r"\w", text[end + 1 : end + 2]):
                    end += 1
                out.add((run[0][0], end))
    return sorted(out)


TERMS = ["adiro", "ácido fólico", "co-trimoxazol forte", "complejo b 12", "b", "Xarelto", "vitamina  k", "®solo", "ácido fólico", "ácido"]
TEXTS = ["Toma ADIRO y ácido fólico.", "ácido-fólico®, Ácido   fólico™x", "co-trimoxazol forte; co trimoxazol forte; co-trimoxazol-forte", "complejo  B-12 y complejob 12",
         "", None, "adiros Xarelto®™ xarelto™", "vitamina k, vitamina  k", "😀 Adiro® b", "nada de nada"]


@pytest.mark.parametrize("wide", [False, True])
def test_lexicon_spans_are_brute_forces(spark, wide):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    lex = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in LX.lexicon_spans(docs, "text", "id", lex, wide=wide).collect()}
    want = {i: s for i, t in enumerate(TEXTS) if (s := brute_spans(t or "", TERMS, wide))}
    assert got == want
    assert LX.lexicon_spans(docs, "text", "id", lex.limit(0), wide=wide).count() == 0


def test_word_filter_lets_every_entry_through(spark):
    entries = spark.createDataFrame([(f"w{i}", i % 3) for i in range(2000)], "first string, n int")
    has = LX.word_filter(entries)
    assert entries.where(has(F.col("first"), F.col("n"))).count() == 2000
    other = spark.createDataFrame([(f"v{i}", 0) for i in range(5000)], "first string, n int")
    assert other.where(has(F.col("first"), F.col("n"))).count() < 250


def test_large_table_protects_in_the_mask(spark):
    lex = spark.range(30_000).select(F.concat(F.lit("farma "), F.lit("6"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("term"))
    docs = spark.createDataFrame([(1, "Toma farma-600000007® hoy"), (2, "Llama al 600000007"), (3, "farma 600099999")], "id int, text string")
    d = docs.join(LX.lexicon_spans(docs, "text", "id", lex, wide=True), "id", "left")
    prof = default_profile(regex=dict(P.PROFILE_REGEX_DEFAULTS))
    got = {r.id: r.m for r in M.mask_text(d, "text", prof, out="m", counts="c", protect=True, lexicon_spans="spans").collect()}
    assert got == {1: "Toma farma-600000007® hoy", 2: "Llama al [TEL]", 3: "farma [TEL]"}


def test_lists_are_resolved_by_spark(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" Adiro \n\nB12\n", encoding="utf-8")
    got = LX.read_lists(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none.txt"), "", None])
    assert sorted(r.term for r in got.collect()) == ["adiro", "b12"]
    assert LX.read_lists(spark, []).count() == 0


def _models(spark):
    """Tiny classifiers whose verdicts are plain: zal* is a drug, everything else is not."""
    words = [("zaltor", "DRUG"), ("zalmar", "DRUG"), ("zalbon", "DRUG")] + [(w, "OTHER") for w in ("garcia", "toledo", "lopez", "burgos", "ruiz", "sanitas")]
    rows = spark.createDataFrame([(i, f"usa {w} hoy", w, y) for i, (w, y) in enumerate(words * 6)], "id long, text string, w string, label string")
    toks = ML.token_rows(TK.with_tokens(rows, "text", "toks"), ["id"], "toks")
    labels = WK.weak_token_labels(toks, "tok", spark.createDataFrame([("zaltor",), ("zalmar",), ("zalbon",)], "term string"))
    token = ML.fit(labels, 30, 1 << 12)
    spans = rows.select("label", ML.span_features(F.lit("usa"), F.col("w"), F.lit("hoy")).alias("features"))
    return ML.fit(spans, 30, 1 << 12), token


def test_both_vetoes_and_their_audit(spark):
    span_model, token_model = _models(spark)
    docs = spark.createDataFrame([(1, "usa Zaltor hoy"), (2, "usa Garcia hoy"), (3, "sin nada"), (4, "va Toledo Zalmar hoy"), (5, None)], "id long, text string")
    found = {1: [("ORG", 4, 10)], 2: [("PER", 4, 10)], 3: [], 4: [("LOC", 3, 16)], 5: []}
    rows = spark.createDataFrame([(i, [(a, b, lab, "x") for lab, a, b in s]) for i, s in found.items()], f"id long, entities {S.SPANS_TYPE}")
    tagged = docs.join(rows, "id")
    verdicts = {r.id: [(v.label, v.span_veto, v.token_veto) for v in r.verdicts] for r in EN.score_entities(tagged, ["id"], "text", span_model, token_model).collect()}
    assert verdicts[1] == [("ORG", True, True)] and verdicts[2] == [("PER", False, False)] and verdicts[4][0][2] and set(verdicts) == {1, 2, 4}
    alone = {r.id: r.verdicts[0] for r in EN.score_entities(tagged, ["id"], "text", None, token_model).collect()}
    assert not alone[1].span_veto and alone[1].token_veto and not alone[2].token_veto
    d = docs.join(EN.score_entities(tagged, ["id"], "text", span_model, token_model), "id", "left").withColumn("ok", EN.accepted("verdicts"))
    prof = default_profile(regex={}, ner_labels=["PER", "ORG", "LOC"], masking={"strategy": "tag", "tag_map": dict(P.DEFAULT_TAG_MAP)})
    masked = M.mask_entities(d, "text", "ok", prof)
    assert {r.id: r.masked for r in masked.collect()} == {1: "usa Zaltor hoy", 2: "usa [NOMBRE] hoy", 3: "sin nada", 4: "va Toledo Zalmar hoy", 5: None}
    audit = {r.label: (r.n_entities, r.n_vetoed, r.n_masked) for r in EN.veto_audit(masked).collect()}
    assert audit == {"ORG": (1, 1, 0), "PER": (1, 0, 1), "LOC": (1, 1, 0)}


def test_bundle_is_loaded_by_another_session(spark):
    span_model, token_model = _models(spark)
    home = f"{ensure_checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    ML.save_bundle(spark, home, {"span": span_model, "token": token_model}, {"drugs": LX.from_terms(spark, ["Zaltor"])}, note="small")
    with pytest.raises(Exception):
        ML.save_bundle(spark, home, {"span": span_model})  # a version is never overwritten
    got = ML.load_bundle(spark.newSession(), home)
    assert set(got.models) == {"span", "token"} and got.about == {"note": "small"} and [r.term for r in got.lexicons["drugs"].collect()] == ["zaltor"]
    rows = ML.token_rows(TK.with_tokens(spark.createDataFrame([(1, "usa Zalbon hoy")], "id long, text string"), "text", "toks"), ["id"], "toks")
    one, two = ([(r.tok, r.pred) for r in ML.predict(m, rows).collect()] for m in (token_model, got.models["token"]))
    assert one == two and ("Zalbon", "DRUG") in one
    # A stream uses the loaded model in its batches.
    src = f"{home}-in"
    spark.createDataFrame([(1, "usa Zalbon hoy"), (2, "usa Lopez hoy")], "id long, text string").write.parquet(src)
    stream = spark.readStream.schema("id long, text string").parquet(src)
    toks = ML.token_rows(TK.with_tokens(stream, "text", "toks"), ["id"], "toks")
    out = MS.run_to_sink(ML.predict(got.models["token"], toks).select("id", "tok", "pred"), "bundle")
    assert {(r.tok, r.pred) for r in spark.read.parquet(out).collect() if r.tok[0].isupper()} == {("Zalbon", "DRUG"), ("Lopez", "OTHER")}
    spark.createDataFrame([(json.dumps({"format": 99, "models": {}, "lexicons": [], "about": {}}),)], "value string").write.text(f"{home}-bad/bundle")
    with pytest.raises(ValueError):
        ML.load_bundle(spark, f"{home}-bad")


def test_redact_is_one_block(spark):
    docs = spark.createDataFrame([(1, "ve a Garcia hoy")], "id int, text string").withColumn("e", F.array(S.span(F.lit(5), F.lit(11), "PER", "x")))
    for more, want in (({}, "ve a █ hoy"), ({"redact_length": True}, "ve a ██████ hoy")):
        prof = default_profile(regex={}, masking={"strategy": "redact"} | more)
        assert M.mask_entities(docs, "text", "e", prof).first().masked == want


@pytest.mark.parametrize("task_rows", [10**6, 40])
def test_stratified_split_is_exact(spark, task_rows):
    rows = [(i, "hot" if i % 3 else ("rare" if i % 30 else None)) for i in range(500)] + [(1000 + i, "few") for i in range(3)]
    got = WK.stratified_split(spark.createDataFrame(rows, "id long, label string"), "label", ["id"], task_rows=task_rows)
    assert got.columns == ["id", "label", "split"] and got.count() == len(rows)
    n = {(r.label, r.split): r.n for r in got.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label in ("hot", "rare", "few", None):
        size = sum(x[1] == label for x in rows)
        assert n.get((label, "test"), 0) == int(0.15 * size + 0.5)
    assert WK.stratified_split(spark.createDataFrame([], "id long, label string"), "label", ["id"]).count() == 0
    again = WK.stratified_split(spark.createDataFrame(rows[::-1], "id long, label string"), "label", ["id"], task_rows=170)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_audit_comes_from_the_write(spark):
    docs = spark.createDataFrame([(1, "DNI 12345678Z", "a"), (2, None, None), (3, "mail x@y.es y z@w.es", "b")], "id long, text string, src string")
    prof = default_profile(text_cols=["text"], structured_types={"src": "pii", "id": "keep"}, protect_drugs=False)
    path = f"{ensure_checkpoint_dir(spark)}/observed-{uuid.uuid4().hex}"
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "one write")
    got = AU.write_masked_observed(docs, prof, path)
    assert len(sc.statusTracker().getJobIdsForGroup(group)) == 1
    sc.setLocalProperty("spark.jobGroup.id", None)
    masked, text, struct = M.mask_table(docs, prof)
    want = AU.audit_table(masked, text, [n for n, _, _ in M.T.text_steps(prof)], struct, docs.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(path).columns == docs.columns and {r.text for r in spark.read.parquet(path).collect()} == {"DNI [DNI]", None, "mail [EMAIL] y [EMAIL]"}
    none = AU.write_masked_observed(docs.limit(0), prof, f"{path}-none")
    assert {r.n for r in none.collect()} == {0}


def test_stream_audit_drops_late_rows_and_repeats_batches(spark):
    home = f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    schema = "ts timestamp, text string"
    batches = [[("2024-01-01 10:05:00", "a@b.es"), ("2024-01-01 10:30:00", "DNI 12345678Z")], [("2024-01-01 13:00:00", "x")], [("2024-01-01 10:50:00", "late@b.es"), ("2024-01-01 15:00:00", "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text").coalesce(1).write.mode("append").parquet(f"{home}/in")
        prof = default_profile(protect_drugs=False)
        stream = spark.readStream.schema(schema).parquet(f"{home}/in")
        masked = M.mask_text(stream, "text", prof, out="m", counts="c", protect=False)
        out = MS.run_to_batches(MS.windowed_audit(masked, "ts", "c", [n for n, _, _ in M.T.text_steps(prof)]), "late", base=f"{home}/run")
    got = sorted((str(r.window_start), r.tag, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 10:00:00", "dni", 1), ("2024-01-01 10:00:00", "email", 1)]


@pytest.mark.parametrize("n", [0, 1, 5, 9, 30])
def test_stitched_tokens_have_most_context(spark, n):
    size, stride = 8, 4
    d = spark.createDataFrame([(n,)], "n int").withColumn("starts", TK.chunk_starts(F.col("n"), size, stride))
    said = lambda s, m: F.transform(S.seq0(m), lambda j: F.concat_ws(":", s.cast("string"), j.cast("string")))
    d = d.withColumn("ch", TK.chunk_tags(F.col("n"), F.col("starts"), said, size))
    got = d.select(TK.stitch_chunks(F.col("n"), F.col("ch"), size, stride).alias("x"), "starts").first()
    for i, x in enumerate(got.x):
        rooms = [(-min(i - s, min(size, n - s) - 1 - (i - s)), s) for s in got.starts if s <= i < s + size]
        assert x == f"{min(rooms)[1]}:{i - min(rooms)[1]}"
    assert len(got.x) == n


def test_ignored_positions_leave_both_sides(spark):
    toks = [(0, 2), (3, 5), (6, 8), (9, 11)]
    row = ([{"start": a, "end": b} for a, b in toks], ["B-X", "-100", "I-X", "O"], ["B-X", "O", "I-X", "B-X"])
    d = spark.createDataFrame([row], "toks array<struct<start:int,end:int>>, gold array<string>, pred array<string>")
    c = EV.sequence_counts(d, "toks", "gold", "pred", "c").first().c
    assert (c.tp, c.fp, c.fn) == (1, 1, 0)


def test_label_ids_send_unknown_to_o(spark):
    d = spark.createDataFrame([(["B-A", "I-A", "B-Z", "O"],)], "t array<string>")
    assert d.select(TK.label_ids(F.col("t"), ["O", "B-A", "I-A"]).alias("x")).first().x == [1, 2, 0, 0]


def test_checked_lines(spark):
    ann = "T1\tLOC 0 6\tMadrid\r\n#1\tnote\nT2\tLOC 6 8\t y\nT3\tLOC 90 99\tz\nT4 LOC 0 6\nR1\tRel a b\nT5\tLOC 0 6;9 11\tx\nT6\tLOC 8 8\t\n"
    docs = spark.createDataFrame([("dev", "d1", "Madrid y Aq", ann), ("dev", "d2", None, "T1\tLOC 0 1\tx"), ("dev", "d3", "abc", None)], "split string, stem string, text string, ann string")
    got = sorted((r.file, r.line_no, r.start, r.end, r.reason, r.frag) for r in C.checked_lines(docs).collect() if r.start is not None)
    assert got == [("d1.ann", 1, 0, 6, None, "Madrid"), ("d1.ann", 3, 6, 8, "isspace-edge", " y"), ("d1.ann", 4, 90, 99, "out-of-range", None),
                   ("d1.ann", 7, 0, 6, None, "Madrid"), ("d1.ann", 7, 9, 11, None, "Aq"), ("d1.ann", 8, 8, 8, "out-of-range", None), ("d2.ann", 1, 0, 1, "out-of-range", None)]
    (bad,) = [r for r in C.checked_lines(docs).collect() if r.start is None]
    assert (bad.line_no, bad.reason, bad.label) == (5, "malformed", None)
    assert C.checked_lines(docs.limit(0)).count() == 0


def test_allowed_and_drug_lexicon_values(spark):
    assert PO.allowed_labels(["ORG", "LOC", "PER"]) == ["LOC", "PER"]
    d = spark.createDataFrame([(" Adiro ",), ("adiros",), (None,)], "t string")
    assert [r[0] for r in d.select(PO.in_drug_lexicon(F.col("t"), ["ADIRO"])).collect()] == [True, False, None]
