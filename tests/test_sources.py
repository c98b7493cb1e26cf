"""Readers and sinks: BOM header, reject TSV, annotation files."""

import os
import tempfile

from velado.sources import readers as R
from velado.sources import sinks as K


def test_bom_csv_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="velado-src-")
    p = os.path.join(d, "train_texts.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿text\nToma Adiro 100 mg.\nVive en Madrid.\n")
    df = R.read_texts(spark, p)
    assert df.columns == ["text"] and df.count() == 2
    rej = spark.createDataFrame([("train", "a.txt", "X", 1, 2, "overlap", "a\tb")],
                                "split string, file string, label string, start int, end int, reason string, frag string")
    K.write_rejects(rej, os.path.join(d, "rejects"))
    back = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(d, "rejects"))
    assert back.columns == K.REJECT_COLUMNS and back.first()["frag"] == "a b"


class _StubModel:
    """Capitalised words as PER: enough to exercise the adapter contract."""

    def predict(self, texts):
        import re

        return [[(m.start(), m.end(), "PER") for m in re.finditer(r"\b[A-Z][a-z]+\b", t)] for t in texts]


def test_model_adapter_contract(spark):
    from velado.operators import adapter as A

    df = spark.createDataFrame([(1, "Juan vive en Madrid"), (2, None), (3, "sin nombres")], "id long, text string")
    out = {r["id"]: [(s["start"], s["end"], s["label"]) for s in r["spans"]]
           for r in A.detect_with_model(df, "id", "text", _StubModel, batch_size=2).collect()}
    assert out == {1: [(0, 4, "PER"), (13, 19, "PER")], 2: [], 3: []}


def test_read_corpus(spark, tmp_path):
    from pyspark.sql import functions as F

    from velado.operators import corpus as C

    for place, stem, text, ann in [("te st", "a+b", "Ana y Luis", "T1\tNOM 6 10\tLuis\nT2\tNOM 0 3\tAna\n"), ("dev/brat", "c", "x", None), ("dev", "d", "y", None)]:
        folder = tmp_path / place
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{stem}.txt").write_text(text, encoding="utf-8")
        if ann:
            (folder / f"{stem}.ann").write_text(ann, encoding="utf-8")
    docs = C.read_corpus(spark, str(tmp_path))
    assert {(r.split, r.stem) for r in docs.collect()} == {("te st", "a+b"), ("dev", "c")}
    d = docs.where("split = 'te st'").withColumn("s", C.parse_ann(F.col("ann"), F.col("text"), file_order=True))
    rows = d.select("stem", F.posexplode("s").alias("pos", "x")).select("stem", "pos", "x.*")
    rows = rows.withColumn("surface", F.when(F.col("start") == 0, "Ana").otherwise("Luis"))
    assert C.first_by_label(rows, ["NOM", "X"], key="stem").first()[1:] == ("NOM", "Luis", "")


def test_lexicon_lists_and_spans(spark, tmp_path):
    from velado.operators import lexicon as LX

    (tmp_path / "a.txt").write_text("San Sebastián\n\n  Madrid \n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("madrid\n" + "\n".join(f"lugar{i}" for i in range(500)), encoding="utf-8")
    lex = LX.read_lists(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), str(tmp_path / "none.txt")])
    assert lex.count() == 502
    docs = spark.createDataFrame([("k1", "Vive en San Sebastián, no en Madrid-Lugar77."), ("k2", None), ("k3", "nada"), ("k4", "san  sebastián")], "k string, text string")
    got = {r["k"]: [(s["start"], s["end"]) for s in r["spans"]] for r in LX.lexicon_spans(docs, "text", "k", lex).collect()}
    assert got == {"k1": [(8, 21), (29, 35), (36, 43)]}
    assert LX.lexicon_spans(docs, "text", "k", lex.limit(0)).count() == 0


def test_label_and_lexicon_helpers(spark):
    from velado.operators import lexicon as LX
    from velado.operators import policy as PO
    from velado.operators import weak as W

    assert PO.allowed_labels(["LOC", "MISC", "PER"]) == ["LOC", "PER"]
    toks = spark.createDataFrame([("Adiro",), ("agua",)], "tok string")
    lex = LX.union_terms(LX.from_terms(spark, ["Adiro "]), LX.from_terms(spark, ["adiro", "nolotil"]))
    assert lex.count() == 2
    assert {r["tok"]: r["label"] for r in W.weak_token_labels(toks, "tok", lex).collect()} == {"Adiro": "DRUG", "agua": "OTHER"}


def test_preview_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", 1), (1, "á", 1), (2, "b", 1)], "i int, t string, __n int")
    K.write_preview(df, str(tmp_path / "p"), 2, "i")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "p")).orderBy("i").collect()] == [("1", "á"), ("2", "b")]
    K.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    K.write_masked(df, str(tmp_path / "m"), dry_run=True)
    K.write_masked(df, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).columns == ["i", "t"] and not (tmp_path / "m").exists()


def test_audit_sink(spark, tmp_path):
    from velado.operators import audit as A

    rows = spark.createDataFrame([("rows", "rows", 3)], "scope string, key string, n long")
    A.write_audit(rows, {"gazetteer_size": 2}, str(tmp_path), "run1")
    assert spark.read.json(str(tmp_path / "summary")).first()["n"] == 3


def test_long_iou_document_and_labels(spark):
    import time

    from pyspark.sql import functions as F

    from velado.functions import spans as S
    from velado.operators import evaluate as E

    spans = lambda step: F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: S.span(i * 10, i * 10 + step, "X"))
    d = spark.range(1).select(spans(6).alias("g"), spans(5).alias("p"))
    began = time.time()
    assert tuple(d.select(E.iou_counts(F.col("g"), F.col("p")).alias("c")).first()["c"]) == (3000, 0, 0)
    assert time.time() - began < 30
    name = "L" * 1500
    toks = spark.createDataFrame([([(0, 1)], ["B-" + name])], "t array<struct<start:int,end:int>>, g array<string>")
    assert toks.select(E.decode_bio("t", "g").alias("s")).first()["s"][0]["label"] == name
