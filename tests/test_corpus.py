"""Annotation parsing (S5/S6/T10) and edge reasons (V8) on hand-made cases."""

from pyspark.sql import functions as F

from velado.operators import corpus as C

TEXT = "Juan vive en Madrid. Tel 600111222"
ANN = "\n".join([
    "T1\tNOMBRE_SUJETO_ASISTENCIA 0 4\tJuan",
    "T2\tTERRITORIO 13 19\tMadrid",
    "T3\tNUMERO_TELEFONO 25 34;35 36\tx",
    "R1\tRel Arg1:T1 Arg2:T2",
    "T4\tBAD a b\tz",
    "T5\tEMPTY 5 5\tz",
    "T6\tOUT 30 99\tz",
    "T7 SPACED 0 4 Juan",
    "garbage",
    "",
])


def test_parse_ann_strict_and_lenient(spark):
    df = spark.createDataFrame([(TEXT, ANN)], "text string, ann string")
    r = df.select(C.parse_ann(F.col("ann"), F.col("text")).alias("s"),
                  C.parse_ann(F.col("ann"), F.col("text"), lenient=True).alias("l")).collect()[0]
    strict = [(x["label"], x["start"], x["end"]) for x in r["s"]]
    assert strict == [("NOMBRE_SUJETO_ASISTENCIA", 0, 4), ("TERRITORIO", 13, 19), ("NUMERO_TELEFONO", 25, 34)]
    lenient = [(x["label"], x["start"], x["end"]) for x in r["l"]]
    assert ("SPACED", 0, 4) in lenient and ("NUMERO_TELEFONO", 25, 34) in lenient


def test_fix_ann_line(spark):
    several = "T1 FARMACO 0 7 Sintrom T2 FARMACO 10 17 Adiro 100 "
    cases = [(several, ["T1\tFARMACO 0 7\tSintrom", "T2\tFARMACO 10 17\tAdiro 100"], True)]
    # Lines with a tab, or not starting with T, are not looked at; one that does not parse is told.
    keep = ["#1\tAnnotatorNotes T1\tsee T1 FARMACO 0 3 abc", "R1 Rel T1 FARMACO 7 18 x", "T1\tFARMACO 0 3\tabc", "T1 FARMACO 0 3 a\tT2 FARMACO 4 5 b", ""]
    cases += [(line, [line], None) for line in keep] + [("T1 PER 0 3 abc", ["T1 PER 0 3 abc"], False)]
    df = spark.createDataFrame([(i, line) for i, (line, *_) in enumerate(cases)], "i int, l string")
    got = [r.x for r in df.orderBy("i").select(C.fix_ann_line(F.col("l")).alias("x")).collect()]
    assert [(x.lines, x.parsed) for x in got] == [c[1:] for c in cases]
    other = spark.createDataFrame([("T1 PER 0 3 abc T2 PER 4 6 de",)], "l string").select(C.fix_ann_line(F.col("l"), "PER").alias("x")).first().x
    assert other.lines == ["T1\tPER 0 3\tabc", "T2\tPER 4 6\tde"]


def test_edge_reasons(spark):
    frags = ["Madrid", " Madrid", "Madrid.", " ", "​", "Ma drid"]
    df = spark.createDataFrame([(f,) for f in frags], "f string")
    got = [r[0] for r in df.select(C.edge_reason(F.col("f"))).collect()]
    assert got == [None, "isspace-edge", "space/punct-edge", "isspace-edge", "empty-after-normalize", None]


def test_template_offsets_round_trip(spark):
    from velado.operators import augment as AG

    df = spark.range(300).withColumnRenamed("id", "k")
    d = AG.templated(df, "k").withColumn("back", C.parse_ann(F.col("synth_ann"), F.col("synth_text")))
    rows = d.select("synth_text", "synth_spans", "back").collect()
    counts = {1: 0, 2: 0, 3: 0}
    for r in rows:
        assert [(s["start"], s["end"]) for s in r["synth_spans"]] == [(s["start"], s["end"]) for s in r["back"]]
        assert "{" not in r["synth_text"]
        counts[len(r["synth_spans"])] += 1
        for s in r["synth_spans"]:
            frag = r["synth_text"][s["start"]:s["end"]]
            assert frag and frag[0].isalpha()
    assert all(v > 0 for v in counts.values())


def test_policy_predicates(spark):
    from velado.functions import spans as S
    from velado.operators import policy as PO

    rows = [("Hospital Universitario La Paz", "ORG"), ("SAMUR", "ORG"), ("Juan Pérez", "PER"), ("Adiro", "PER"),
            ("urgencias", "ORG"), ("Madrid", "GPE"), ("metformina", "LOC")]
    df = spark.createDataFrame(rows, "t string, label string")
    got = df.select("t", PO.is_drug_name(F.col("t")).alias("drug"), PO.is_generic_acronym(F.col("t")).alias("acr"),
                    PO.precision_first(F.col("label"), F.col("t")).alias("pf"),
                    PO.conservative(F.col("label"), F.col("t")).alias("cons"),
                    PO.in_drug_lexicon(F.col("t"), ["adiro"]).alias("lex")).collect()
    g = {r["t"]: r for r in got}
    assert g["Hospital Universitario La Paz"]["pf"] and not g["SAMUR"]["pf"] and g["SAMUR"]["acr"]
    assert g["Juan Pérez"]["cons"] and not g["Adiro"]["cons"] and g["Adiro"]["lex"] and g["Adiro"]["drug"]
    assert not g["urgencias"]["pf"] and g["Madrid"]["cons"] and not g["metformina"]["cons"]
    t = spark.createDataFrame([("Tratamiento con Adiro 100 mg hoy", [(16, 21, "X", None), (26, 29, "Y", None)])],
                              f"text string, sp {S.SPANS_TYPE}")
    flags = t.select(F.transform("sp", lambda s: PO.probable_drug_segment(F.col("text"), s, ["adiro"])).alias("f")).first()["f"]
    assert flags == [True, False]


def test_without_annotations(spark):
    """An empty or repeated file is a file; null keys match nothing; other columns do not clash."""
    texts = spark.createDataFrame([("a", "x", "t"), ("a", "y", "t"), ("b", "x", None), (None, "x", "t")], "split string, stem string, text string")
    files = spark.createDataFrame([("a", "x", ""), ("a", "x", "T1"), ("c", "x", "T1")], "split string, stem string, text string")
    got = sorted(tuple(r) for r in C.without_annotations(texts, files).na.fill("?").collect())
    assert got == [("?", "x", "NO_ANN"), ("a", "y", "NO_ANN"), ("b", "x", "NO_ANN")]
    assert C.without_annotations(texts.limit(0), files).count() == 0


def test_annotated_corpus_uses_all_cores(spark, tmp_path):
    """A table of one row group is one split; the corpus made from it is checked by as many tasks as there are cores."""
    from velado.plans import q_corpus as QC
    from velado.plans import registry as R

    rows = [(i, f"Customer#{i:09d}") for i in range(1, 400)] + [(None, "x"), (7, None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    kept = spark.conf.get(R.SPREAD_CONF)
    spark.conf.unset(R.SPREAD_CONF)
    try:
        sizes = QC._annotated(spark, str(tmp_path)).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    finally:
        spark.conf.set(R.SPREAD_CONF, kept)
    assert sum(sizes) == 401 and len(sizes) >= spark.sparkContext.defaultParallelism > 1 and min(sizes) > 100


def test_check_text_of_a_fragment(spark):
    frags = ["a\u00a0b", "\u200ba\ufeff", "\u00a0", "\ufeff\u200b", "", "a b", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(frags)], "i int, x string")
    got = [r["c"] for r in df.select("i", C.check_text(F.col("x")).alias("c")).orderBy("i").collect()]
    assert got == ["a b", "a", " ", "", "", "a b", None]
