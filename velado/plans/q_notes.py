"""Clinical notes made from the columns of ``orders`` and ``customer``, and the rules run over them.

Every note holds identifiers, contact data, dates, a residence and medication built from the row's keys, with
controls that must not match, so each rule fires on the whole table and is held against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import structured as ST
from ..operators import audit as A
from ..operators import detect as D
from ..operators import entities as EN
from ..operators import lexicon as LX
from ..operators import mask as M
from ..operators import policy as PO
from ..profile import default_profile
from .registry import register, spread, table
from .sqlpat import ci, profile_steps, re2, sq

TOWNS = ["Toledo", "Burgos", "Lugo", "Soria"]
DRUGS = ["adiro", "enalapril", "omeprazol", "atorvastatina", "lorazepam", "morfina"]
UNITS = ["mg", "ml", "ui"]
MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
LETTERS = "ABCDEFHJ"  # no G: after a number it is a unit, and the dose rule protects it


def _pick(values, key):
    """SQL text (Spark's and DuckDB's alike): the value at ``key % n``."""
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


def _pad(expr, n):
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


_DAY, _MONTH, _YEAR = "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)"
_SHORT = f"concat({_pad(_DAY, 2)}, '/', {_pad(_MONTH, 2)}, '/', substr(CAST({_YEAR} AS STRING), 3, 2))"
_LONG = f"concat({_pad(_DAY, 2)}, '/', {_pad(_MONTH, 2)}, '/', CAST({_YEAR} AS STRING))"
_NAMED = f"concat(CAST({_DAY} AS STRING), ' ', {_pick(MONTHS, f'({_MONTH} - 1)')}, ' ', CAST({_YEAR} AS STRING))"
_LETTER = f"substr('{LETTERS}', CAST(o_orderkey % {len(LETTERS)} + 1 AS INT), 1)"

#: Sentences of a note, and for each which rows (by key) have it.
SENTENCES = [
    ("o_orderkey % 2 = 0", f"concat('DNI ', {_pad('o_orderkey % 100000000', 8)}, {_LETTER}, '. ')"),
    ("o_orderkey % 3 = 0", f"concat('NIE X', {_pad('c_custkey % 10000000', 7)}, {_LETTER}, '. ')"),
    ("o_orderkey % 4 = 1", f"concat('Movil: 6', {_pad('o_orderkey % 100000000', 8)}, '. ')"),
    ("o_orderkey % 5 < 2", "concat('Escribe a ', lower(replace(c_name, '#000', '.')), '@correo.es hoy. ')"),
    ("o_orderkey % 2 = 1", f"concat('Fecha ', {_LONG}, '. ')"),
    ("o_orderkey % 4 = 2", f"concat('Alta ', {_SHORT}, ' y ', {_NAMED}, '. ')"),
    ("c_custkey % 3 = 1", f"concat('Vive en ', {_pick(TOWNS, 'c_custkey')}, ' sola. ')"),
    ("c_custkey % 2 = 0", f"concat('Recibe ', {_pick(DRUGS, 'o_orderkey')}, ' ', CAST(o_orderkey % 90 + 10 AS STRING), ' ', {_pick(UNITS, 'c_custkey')}, ' al dia. ')"),
    ("c_custkey % 5 = 3", f"concat('Alergia a ', {_pick(TOWNS, 'o_orderkey')}, '. ')"),
    ("o_orderkey % 7 = 0", "concat('Caja ', CAST(o_orderkey AS STRING), 'A9 del lote A', CAST(c_custkey AS STRING), '. ')"),
    ("o_orderkey % 6 = 5", "concat('NHC: ', CAST(c_custkey + 1000 AS STRING), ' ver https://sitio.es/', CAST(o_orderkey AS STRING), ' hoy. ')"),
    ("o_orderkey % 8 = 3", f"concat('Seguro 28 ', {_pad('o_orderkey', 10)}, '. ')"),
]
NOTE = "concat(" + ", ".join(f"CASE WHEN {when} THEN {text} ELSE '' END" for when, text in SENTENCES) + ", 'Fin.')"
NOTES_SQL = f"(SELECT o_orderkey, c_custkey, o_orderdate, {NOTE} AS text FROM orders JOIN customer ON c_custkey = o_custkey)"


def notes(spark, sf):
    """``o_orderkey, c_custkey, o_orderdate, text``: one note for each order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return spread(j, "o_orderkey").select("o_orderkey", "c_custkey", "o_orderdate", F.expr(NOTE).alias("text"))


def _chain(steps, keep):
    ctes = [f"s0 AS (SELECT {keep}, text AS t0 FROM {NOTES_SQL})"]
    for i, (name, pat, tag) in enumerate(steps, start=1):
        ctes.append(f"s{i} AS (SELECT *, len(regexp_extract_all(t{i - 1}, {pat})) AS n_{name}, "
                    f"regexp_replace(t{i - 1}, {pat}, {sq(tag)}, 'g') AS t{i} FROM s{i - 1})")
    names = ", ".join(f"n_{s[0]}" for s in steps)
    return f"WITH {', '.join(ctes)}\nSELECT {keep}, t{len(steps)} AS masked, {names} FROM s{len(steps)}"


_STEPS = [s for s in profile_steps() if s[0] in P.REGEX_ORDER] + [("heur", ci(P.HEURISTIC_RESIDENCE), r"\1 [LOC]")]


@register("mask_notes", "M8 D1 D6 M10 (every key fires)", "orders customer", _chain(_STEPS, "o_orderkey"))
def mask_notes(spark, sf):
    prof = default_profile(regex=dict(P.PROFILE_REGEX_DEFAULTS))
    d = M.mask_text(notes(spark, sf), "text", prof, out="masked", counts="c", protect=False)
    return d.select("o_orderkey", "masked", *[F.col(f"c.{s[0]}").alias(f"n_{s[0]}") for s in _STEPS])


_RULES = [(n, ci(p) if icase else sq(re2(p)), tag) for n, p, tag, icase in P.RULES_FIRST]


@register("rules_first_notes", "M9 D2 (every rule fires)", "orders customer", _chain(_RULES, "o_orderkey"))
def rules_first_notes(spark, sf):
    out, counts = M.T.rules_first(F.col("text"))
    return notes(spark, sf).select("o_orderkey", out.alias("masked"), *[n.alias(f"n_{k}") for k, n in counts.items()])


def _hard_sql():
    parts = []
    for i, (label, pat, icase) in enumerate(P.HARD_REGEXES):
        p = ci(pat) if icase else sq(re2(pat))
        parts.append(f"SELECT o_orderkey, {i} AS rule, '{label}' AS label, unnest(regexp_extract_all(text, {p})) AS surface FROM n")
    return f"""WITH n AS (SELECT * FROM {NOTES_SQL}), m AS ({' UNION ALL '.join(parts)})
SELECT label, rule, count(*) AS n, count(DISTINCT o_orderkey) AS notes, CAST(sum(length(surface)) AS BIGINT) AS chars FROM m GROUP BY label, rule"""


@register("hard_spans_notes", "D3 (all seven patterns)", "orders customer", _hard_sql())
def hard_spans_notes(spark, sf):
    d = notes(spark, sf)
    dets = [dict(out=f"d{i}", pattern=p, label=lab, src="re") for i, (lab, p) in enumerate(D.hard_detectors())]
    d = S.with_regex_spans_multi(d, "text", dets)
    tagged = [F.transform(f"d{i}", _with_rule(i)) for i in range(len(dets))]
    rows = S.explode_rows(d, F.flatten(F.array(*tagged)), ["o_orderkey"]).select("o_orderkey", "s.*")
    return rows.groupBy("label", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("notes"),
                                             F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


def _with_rule(i):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(i).alias("rule"))


# Medication of a note, as SQL knows it from the sentence that was put in: the drug sentence's dose span ("<drug> <n>
# <unit>") and the allergy sentence's capital word.
_HAS_DOSE, _HAS_ALLERGY = SENTENCES[7][0], SENTENCES[8][0]
_DOSE_TEXT = f"concat({_pick(DRUGS, 'o_orderkey')}, ' ', CAST(o_orderkey % 90 + 10 AS STRING), ' ', {_pick(UNITS, 'c_custkey')})"


@register(
    "protected_notes",
    "D8 D10 D11 D13 D14 V1 (medication spans)",
    "orders customer",
    f"""SELECT o_orderkey, CAST((CASE WHEN {_HAS_DOSE} THEN 1 ELSE 0 END) + (CASE WHEN {_HAS_ALLERGY} THEN 1 ELSE 0 END) AS INTEGER) AS n_protected,
       concat_ws('|', CASE WHEN {_HAS_DOSE} THEN {_DOSE_TEXT} END, CASE WHEN {_HAS_ALLERGY} THEN {_pick(TOWNS, 'o_orderkey')} END) AS surfaces
FROM {NOTES_SQL}""",
)
def protected_notes(spark, sf):
    d = D.with_drug_spans(notes(spark, sf), "text", "prot", P.BUILTIN_DRUGS)
    d, blk = S.with_blocks(d, "text")
    surfaces = S.pinned(blk, F.array_join(F.transform("prot", lambda s: S.surface(F.col("text"), s, F.col(blk))), "|"))
    return d.select("o_orderkey", F.size("prot").alias("n_protected"), surfaces.alias("surfaces"))


def _protected_mask_sql():
    """Mask the text in parts: what a medication sentence protects stays, every other sentence goes through the chain."""
    steps = [(p, t) for _, p, t in _STEPS]

    def masked(expr):
        for pat, tag in steps:
            expr = f"regexp_replace({expr}, {pat}, {sq(tag)}, 'g')"
        return expr

    parts = []
    for k, (when, text) in enumerate(SENTENCES):
        body = text if k in (7, 8) else masked(text)
        parts.append(f"CASE WHEN {when} THEN {body} ELSE '' END")
    return f"""SELECT o_orderkey, concat({', '.join(parts)}, 'Fin.') AS masked
FROM orders JOIN customer ON c_custkey = o_custkey"""


@register("protected_mask_notes", "M8 M6 M7 D14 (protection kept, everything else masked)", "orders customer", _protected_mask_sql())
def protected_mask_notes(spark, sf):
    prof = default_profile(regex=dict(P.PROFILE_REGEX_DEFAULTS), drug_lexicon_extra=P.BUILTIN_DRUGS)
    d = M.mask_text(notes(spark, sf), "text", prof, out="masked", counts="c", protect=True)
    return d.select("o_orderkey", "masked")


# What a tagger says about a note: a place after "en" or "a", a person, a drug taken for an organisation, and a label
# that the profile does not list.
PREDICTED = [("LOC", r"\b(?:en|a)\s+(" + "|".join(TOWNS) + ")", 1), ("PER", "sola", 0), ("ORG", r"Recibe\s+(\w+)", 1), ("OTHER", "Fin", 0)]
NER_LABELS = ["PER", "LOC", "ORG"]


def predicted_notes(spark, sf):
    dets = [dict(out=f"p{i}", pattern=p, label=lab, src="tagger", group=g) for i, (lab, p, g) in enumerate(PREDICTED)]
    d = S.with_regex_spans_multi(notes(spark, sf), "text", dets)
    return d.withColumn("entities", F.concat(*[d["out"] for d in dets])).drop(*[d["out"] for d in dets])


def _ner_sql(place, person):
    """The protected mask, but for the residence sentence: its place and person are entities."""
    base = _protected_mask_sql()
    k = next(i for i, (_, text) in enumerate(SENTENCES) if "Vive en" in text)
    when, text = SENTENCES[k]
    mask = text
    for pat, tag in [(p, t) for _, p, t in _STEPS]:
        mask = f"regexp_replace({mask}, {pat}, {sq(tag)}, 'g')"
    return base.replace(f"CASE WHEN {when} THEN {mask} ELSE '' END", f"CASE WHEN {when} THEN concat('Vive en ', {place}, ' ', {person}, '. ') ELSE '' END")


_TOWN = _pick(TOWNS, "c_custkey")


def _masked_entities(spark, sf, strategy):
    prof = default_profile(regex=dict(P.PROFILE_REGEX_DEFAULTS), drug_lexicon_extra=P.BUILTIN_DRUGS, ner_labels=NER_LABELS,
                           masking={"strategy": strategy, "tag_map": dict(P.DEFAULT_TAG_MAP)})
    return M.mask_entities(predicted_notes(spark, sf), "text", "entities", prof)


@register("ner_mask_notes", "M8 D7 L6-role F1p N1 N3 V10 M1", "orders customer", _ner_sql("'[LOC]'", "'[NOMBRE]'"))
def ner_mask_notes(spark, sf):
    return _masked_entities(spark, sf, "tag").select("o_orderkey", "masked")


@register("ner_redact_notes", "M8 M1 (redact)", "orders customer", _ner_sql("'█'", "'█'"))
def ner_redact_notes(spark, sf):
    return _masked_entities(spark, sf, "redact").select("o_orderkey", "masked")


@register(
    "ner_audit_notes",
    "A1 (per_ent)",
    "orders customer",
    f"""SELECT 'per_ent' AS scope, label AS key, count(*) AS n FROM (SELECT unnest(['LOC', 'PER']) AS label FROM {NOTES_SQL}
WHERE {next(when for when, text in SENTENCES if 'Vive en' in text)}) GROUP BY label""",
)
def ner_audit_notes(spark, sf):
    return A.per_entity(_masked_entities(spark, sf, "tag"), "c")


_RENDERED = [("slash", _LONG, True), ("short", _SHORT, True), ("iso", f"concat(CAST({_YEAR} AS STRING), '-', {_pad(_MONTH, 2)}, '-', {_pad(_DAY, 2)})", True),
             ("iso_time", f"concat(CAST({_YEAR} AS STRING), '-', {_pad(_MONTH, 2)}, '-', {_pad(_DAY, 2)}, 'T10:20:30')", True),
             ("year_first", f"concat(CAST({_YEAR} AS STRING), '/', {_pad(_MONTH, 2)}, '/', {_pad(_DAY, 2)})", True),
             ("seconds", f"concat({_LONG}, ' 10:20:30')", True), ("dots", f"replace({_LONG}, '/', '.')", True), ("words", _NAMED, False)]


@register("date_years", "M5 (all written forms)", "orders",
          "SELECT o_orderkey, " + ", ".join(f"{'CAST(year(o_orderdate) AS STRING)' if ok else repr('')} AS {n}" for n, _, ok in _RENDERED) + " FROM orders")
def date_years(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", *[F.expr(sql).alias(n) for n, sql, _ in _RENDERED])
    return o.select("o_orderkey", *[ST.date_to_year(F.col(n)).alias(n) for n, _, _ in _RENDERED])


_CASES = [("vive con", "Juan Perez", False), ("en tratamiento con", "Sintrom", True), ("tto. con", "Lugo", True), ("ve a", "Adiro 100", True),
          ("toma", "algo", False), ("usa", "morfina hoy", True), ("profilaxis con", "Soria", True), ("sale con", "Enalapril 5 mg", True)]


@register(
    "drug_segments",
    "F7p F12p",
    "orders",
    f"""SELECT o_orderkey, CAST({_pick([str(c[2]).lower() for c in _CASES], 'o_orderkey')} AS BOOLEAN) AS drug,
       o_orderkey % 5 < 2 AS drug_label FROM orders""",
)
def drug_segments(spark, sf):
    before, seg = _pick([c[0] for c in _CASES], "o_orderkey"), _pick([c[1] for c in _CASES], "o_orderkey")
    label = _pick(["chemical", "Active_substance", "PER", "LOC", "MEDICO"], "o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(before).alias("before"), F.expr(seg).alias("seg"), F.expr(label).alias("label"))
    o = o.withColumn("text", F.concat("before", F.lit(" "), "seg")).withColumn(
        "s", S.span(F.length("before") + 1, F.length("text"), "X"))
    return o.select("o_orderkey", PO.probable_drug_segment(F.col("text"), F.col("s"), P.BUILTIN_DRUGS).alias("drug"),
                    PO.drug_label(F.col("label")).alias("drug_label"))


#: A drug of the table: three words, the last of which the phone rule would mask.
_CODE = f"concat('6', {_pad('o_orderkey', 8)})"
_WRITTEN = [f"concat('complejo b ', {_CODE})", f"concat('Complejo B-', {_CODE}, '®')", f"concat('COMPLEJO  b\t', {_CODE}, '™')"]
_BOX = "concat('Guarda el ', CASE o_orderkey % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_WRITTEN)) + " END, ' en casa. ')"
_IN_TABLE = "o_orderkey % 2 = 0"


def drug_table(spark, sf):
    """Terms that grow with the orders: a drug for every second order, and one with another letter for each."""
    o = table(spark, sf, "orders")
    own = o.where(_IN_TABLE).select(F.expr(f"concat('complejo b ', {_CODE})").alias("term"))
    return own.unionByName(o.select(F.expr(f"concat('complejo ce ', {_CODE})").alias("term")))


def _lexicon_mask_sql():
    box = _BOX
    for _, pat, tag in _STEPS:
        box = f"regexp_replace({box}, {pat}, {sq(tag)}, 'g')"
    return _protected_mask_sql().replace("concat(CASE", f"concat(CASE WHEN {_IN_TABLE} THEN {_BOX} ELSE {box} END, CASE", 1)


@register("lexicon_mask_notes", "M8 D8 (wide form, a drug table that grows with the data)", "orders customer", _lexicon_mask_sql())
def lexicon_mask_notes(spark, sf):
    d = notes(spark, sf).withColumn("text", F.concat(F.expr(_BOX), "text"))
    found = LX.lexicon_spans(d, "text", "o_orderkey", drug_table(spark, sf), label="DRUG", wide=True).withColumnRenamed("spans", "table_spans")
    d = EN.spread_rows(d.join(found, "o_orderkey", "left"), ["o_orderkey"])
    prof = default_profile(regex=dict(P.PROFILE_REGEX_DEFAULTS), drug_lexicon_extra=P.BUILTIN_DRUGS)
    return M.mask_text(d, "text", prof, out="masked", counts="c", protect=True, lexicon_spans="table_spans").select("o_orderkey", "masked")


#: Sentences with entities that stand beside or inside medication, near misses of those, and the entities that the conservative
#: policy and the overlap veto leave.
_NEAR = [
    (f"concat('Visto por Ana Ruiz en ', {_pick(TOWNS, 'o_custkey')}, '.')", f"concat('PER:Ana Ruiz|LOC:', {_pick(TOWNS, 'o_custkey')})"),
    ("'Hoy toma Adiro Ruiz.'", "''"),
    (f"concat('Vive en ', {_pick(TOWNS, 'o_custkey')}, ' ', CAST(o_orderkey % 90 + 10 AS STRING), ' mg.')", "''"),
    (f"concat('Vive en ', {_pick(TOWNS, 'o_custkey')}, ' ', CAST(o_orderkey % 90 + 10 AS STRING), ' km.')", f"concat('LOC:', {_pick(TOWNS, 'o_custkey')})"),
    (f"concat('Alergia a Burgos, vive en ', {_pick(TOWNS, 'o_custkey')}, '.')", f"concat('LOC:', {_pick(TOWNS, 'o_custkey')})"),
    ("'Nota de ANA RUIZ.'", "''"),
    ("'Visto por Eva Adiroso.'", "'PER:Eva Adiroso'"),
    ("'Recibe Omeprazol Normon.'", "''"),
]


def _near(k):
    return "CASE " + " ".join(f"WHEN o_orderkey % {len(_NEAR)} = {i} THEN {x[k]}" for i, x in enumerate(_NEAR)) + " END"


@register("conservative_entities", "F10p F4p N1 D8 D13 (near misses of medication kept, overlaps dropped)", "orders", f"SELECT o_orderkey, {_near(1)} AS kept FROM orders")
def conservative_entities(spark, sf):
    rows = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", F.expr(_near(0)).alias("text"))
    found = [("PER", r"\b[A-Z][a-z]+ [A-Z][a-z]+", 0), ("LOC", r"\ben ([A-Z][a-z]+)", 1)]
    dets = [dict(out=f"p{i}", pattern=p, label=lab, src="tagger", group=g) for i, (lab, p, g) in enumerate(found)]
    d = S.with_regex_spans_multi(rows, "text", dets).withColumn("entities", S.sort_spans(F.concat("p0", "p1"))).drop("p0", "p1")
    d = D.with_drug_spans(d, "text", "prot", ["adiro"])
    d, blk = S.with_blocks(d, "text")
    surface = lambda e: S.surface(F.col("text"), e, F.col(blk))
    d = d.withColumn("entities", S.pinned(blk, F.filter("entities", lambda e: PO.conservative(e["label"], surface(e)))))
    d = d.withColumn("entities", S.pinned("prot", PO.veto_protected(F.col("entities"), F.col("prot"))))
    kept = F.transform("entities", lambda e: F.concat(e["label"], F.lit(":"), surface(e)))
    return d.select("o_orderkey", S.pinned(blk, F.array_join(kept, "|")).alias("kept"))
