"""Findings F3 to F7 of round 3: scores that look up only a row's features, samples drawn without a row for every token."""

import hashlib

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from velado.operators import ml as ML
from velado.operators import tokens as TK

DOCS = [(1, "usa Adiro cien hoy"), (1, "usa Adiro cien hoy"), (2, " ".join(f"p{i}" for i in range(60))), (None, "ve a Adiro"), (3, None), (4, "")]


def test_scores_equal_those_of_the_fitted_model(spark, tmp_path):
    train = spark.createDataFrame([("DRUG", ["t=adiro", "n=cien"]), ("DRUG", ["t=adiro"]), ("OTHER", ["t=ve"]), ("OTHER", ["t=a", "n=cien"]), ("X", ["t=q"])],
                                  "label string, features array<string>")
    rows = spark.createDataFrame([(0, ["t=adiro", "n=cien"]), (1, ["t=new", "t=new"]), (2, []), (3, ["t=q", "t=ve"])], "k int, features array<string>")
    for i, data in enumerate((train, train.where("label = 'X'"))):
        model = ML.fit(data, max_iter=20)
        # Spark's own scoring of a model with a training summary fails in a session that has observed a DataFrame.
        model.write().save(f"{tmp_path}/m{i}")
        loaded = PipelineModel.load(f"{tmp_path}/m{i}")
        want = {r.k: (r.p, r.prediction_) for r in loaded.transform(rows.withColumn("label", F.lit("X"))).select(
            "k", vector_to_array("proba").alias("p"), F.col("y_hat").alias("prediction_")).collect()}
        for r in ML.predict(model, rows).collect():
            assert list(r.proba) == pytest.approx(list(want[r.k][0]))
            seen = r.proba[: len(model.stages[0].labels)]
            assert r.pred == model.stages[0].labels[seen.index(max(seen))]


def _labelled(spark):
    d = TK.with_tokens(spark.createDataFrame(DOCS, "id long, text string"), "text", "toks")
    return d.withColumn("tags", F.transform("toks", lambda t: F.when(t["tok"] == "Adiro", "DRUG").otherwise("OTHER")))


@pytest.mark.parametrize("per_label", [1, 2, 5, 1000])
def test_samples_in_rows_are_the_lowest_hashes_of_each_label(spark, per_label):
    rows = lambda docs, kept: ML.with_features(ML.token_rows(docs, ["id"], "toks", "lab", features=False, kept=kept))
    got = ML.sample_in_rows(_labelled(spark).withColumn("lab", TK.tags_by_place("tags")), "lab", ["id"], per_label, rows)
    every = ML.token_rows(_labelled(spark), ["id"], "toks", "tags").collect()
    h = lambda r: hashlib.md5("|".join(str(x) for x in (r.id, r.i) if x is not None).encode()).hexdigest()
    want = []
    for label in ("DRUG", "OTHER"):
        want += sorted((h(r), r.tok, tuple(r.features)) for r in every if r.label == label)[:per_label]
    assert sorted((h(r), r.tok, tuple(r.features)) for r in got.collect()) == sorted(want)
    again = ML.bounded_sample(ML.token_rows(_labelled(spark), ["id"], "toks", "tags"), per_label, ["id", "i"])
    assert sorted((h(r), r.tok, tuple(r.features)) for r in again.collect()) == sorted(want)


def test_two_tag_columns_are_decoded_from_one_collect(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, "B-A", "O"), (1, 1, 4, 6, "I-A", "B-A"), (2, 0, 0, 1, "O", "O")], "id long, i int, start int, end int, label string, pred string")
    got = {r.id: (r.g, r.p) for r in ML.spans_from_predictions(rows, ["id"], {"label": "g", "pred": "p"}).collect()}
    assert [(s.start, s.end) for s in got[1][0]] == [(0, 6)] and [(s.start, s.end) for s in got[1][1]] == [(4, 6)] and got[2] == ([], [])
    r = {x.label: x for x in ML.report(rows).collect()}
    assert (r["O"].support, r["O"].precision, r["O"].recall, r["I-A"].recall, r["I-A"].support) == (1, 0.5, 1.0, 0.0, 1)


@pytest.mark.parametrize(("max_len", "stride"), [(4, 2), (5, 3), (6, 1), (4, 0), (7, 5)])
def test_stitched_runs_take_the_chunk_with_most_room(spark, max_len, stride):
    step = max_len - stride
    df = spark.range(0, 40).select(F.col("id").cast("int").alias("n")).withColumn("starts", TK.chunk_starts(F.col("n"), max_len, stride))
    tags = lambda s, size: F.transform(F.sequence(F.lit(0), size), lambda j: F.concat_ws(":", s, j))
    df = df.withColumn("chunks", TK.chunk_tags(F.col("n"), F.col("starts"), lambda s, size: F.slice(tags(s, size), 1, size), max_len))
    stitched = TK.stitch_chunks(F.col("n"), F.col("chunks"), max_len, stride)
    assert "array_min" not in df.select(stitched)._jdf.queryExecution().toString()  # no search for each token
    for r in df.select("n", "starts", stitched.alias("got")).collect():
        want = []
        for i in range(r.n):
            inside = [(-min(i - s, min(s + max_len, r.n) - 1 - i), s) for s in r.starts if s <= i < min(s + max_len, r.n)]
            s = min(inside)[1]
            want.append(f"{s}:{i - s}")
        assert r.got == want, (r.n, step)
