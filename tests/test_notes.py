"""Every rule fires on the notes made from the tables."""

from pyspark.sql import functions as F

from velado.functions import patterns as P
from velado.plans import q_notes as N

from .conftest import SF


def test_every_key_fires(spark):
    for query in (N.mask_notes, N.rules_first_notes):
        d = query(spark, SF)
        sums = d.agg(*[F.sum(c).alias(c) for c in d.columns if c.startswith("n_")]).first().asDict()
        assert len(sums) >= 3 and all(n > 0 for n in sums.values()), sums


def test_every_hard_pattern_fires(spark):
    assert {r["rule"] for r in N.hard_spans_notes(spark, SF).collect()} == set(range(len(P.HARD_REGEXES)))


def test_medication_is_protected_and_the_rest_masked(spark):
    rows = N.protected_mask_notes(spark, SF).join(N.protected_notes(spark, SF), "o_orderkey").collect()
    assert any(r["n_protected"] == 2 for r in rows) and any(r["n_protected"] == 0 for r in rows)
    for r in rows:
        assert all(x in r["masked"] for x in r["surfaces"].split("|"))
        assert "@" not in r["masked"] and "DNI 0" not in r["masked"]


def test_span_classifier_vetoes_drugs_only(spark):
    from velado.plans.q_ml import span_classifier_veto

    got = {r["entity_label"]: (r["n_entities"], r["n_kept"]) for r in span_classifier_veto(spark, SF).collect()}
    assert set(got) == {"LOC", "PER", "ORG", "OTHER"}
    assert got["ORG"][1] < 0.1 * got["ORG"][0]  # drugs taken for organisations
    assert got["PER"][1] > 0.9 * got["PER"][0]


def test_token_veto_hits(spark):
    from velado.operators import ml
    from velado.plans.q_ml import span_classifier_veto

    ents = spark.createDataFrame([(1, 0, 5), (1, 10, 80), (1, 90, 95), (2, 0, 5)], "doc long, start int, end int")
    toks = spark.createDataFrame([(1, 4, 9, "DRUG"), (1, 70, 75, "DRUG"), (1, 95, 99, "DRUG"), (2, 0, 5, "OTHER")], "doc long, start int, end int, pred string")
    assert sorted(tuple(r) for r in ml.veto_hits(ents, toks, ["doc"]).collect()) == [(1, 0, 5, True), (1, 10, 80, True)]
    got = {r["entity_label"]: r for r in span_classifier_veto(spark, SF).collect()}
    print("VETO", {k: tuple(r)[1:] for k, r in got.items()})
    assert got["ORG"]["n_token_veto"] > 0 and got["ORG"]["n_span_veto"] > 0
    for r in got.values():
        assert max(r["n_span_veto"], r["n_token_veto"]) <= r["n_entities"] - r["n_kept"] <= r["n_span_veto"] + r["n_token_veto"]
