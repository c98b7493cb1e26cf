"""Trained operators: gradients, held-out accuracy on made texts, and defined results for odd rows."""

import random

import numpy as np
import pandas as pd
import pytest

from velado.llm import gru, langid, quality, toxicity

from .conftest import EDGE

SYLLABLES = {"en": ["th", "er", "ing", "wh", "ou"], "de": ["sch", "ung", "ei", "ß", "ü"], "es": ["ci", "ón", "ado", "ll", "ñ"]}


def prose(rng, lang, n, extra=()):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for x in extra:
        words.insert(rng.randint(0, len(words)), x)
    return " ".join(words) + "."


def test_gru_gradient():
    rng = np.random.default_rng(0)
    g, u = rng.standard_normal((5, 3, 12)).astype(np.float32), rng.standard_normal((4, 12)).astype(np.float32) * 0.5
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])[None, :]
    target = rng.standard_normal((5, 3, 4)).astype(np.float32)
    loss = lambda g, u: float((gru.gru_forward(g, mask, u)[0].astype(float) * target).sum())
    out, kept = gru.gru_forward(g, mask, u)
    dg, du = gru.gru_backward(target, kept, u)
    for array, grad in ((g, dg), (u, du)):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old, eps = array[at], 1e-2
            array[at] = old + eps
            up = loss(g, u)
            array[at] = old - eps
            down = loss(g, u)
            array[at] = old
            assert abs((up - down) / (2 * eps) - grad[at]) < 2e-2 * max(1, abs(grad[at]))
    h = np.zeros((3, 4), np.float32)
    assert np.allclose(gru.gru_step(g[0].copy(), h, u), out[0], atol=1e-5)


@pytest.fixture(scope="module")
def languages(make):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(3, 40)), lang, "h") for i, lang in enumerate(["en", "de", "es"] * 80)]
    extra = [(1000, None, "en", "h"), (1001, "", "de", "h"), (1002, "123 | %% 45", "en", "h"), (1003, "中文", None, "h"), (1004, prose(rng, "de", 20000), None, "h")]
    return make(rows + rows[:2] + extra + EDGE[5:6]), len(rows) + 2 + 6


def test_language_held_out(languages, make):
    docs, n = languages
    got = langid.detect(docs).toPandas()
    assert len(got) == n
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    truth = docs.select("doc_id", "lang").toPandas().dropna().drop_duplicates("doc_id").set_index("doc_id").lang
    held = by[by.held_out & (by.index < 1000)]
    assert len(held) > 30 and (held.lang_pred == truth.loc[held.index]).mean() >= 0.95
    assert list(by.lang_pred.loc[[1000, 1001, 1002]]) == ["und"] * 3 and by.lang_pred[1003] != "und" and by.lang_pred[1004] == "de"
    assert got.score.between(0, 1).all()
    assert langid.detect(make([])).count() == 0
    assert set(langid.detect(make([(1, "abc", None, None)])).toPandas().lang_pred) == {"und"}


def toxic_rows(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, prose(rng, "en", rng.randint(5, 120), ["vilgrub" + rng.choice(["a", "en", "os", "ing"])] * 2 if bad else ()), "en", "h"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark, make):
    docs, labels = toxic_rows(random.Random(2), 500)
    long = prose(random.Random(3), "en", 5000, ["vilgruba"])
    docs += [(9000, long, "en", "h"), (9001, prose(random.Random(4), "en", 5000), "en", "h")] + EDGE[:6]
    table = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(make(docs), table).toPandas()
    assert len(got) == len(docs)
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    truth = pd.Series({i: t for i, _, t in labels})
    held = by[by.held_out & by.index.isin(truth.index) & (by.index > 10)]
    assert (held.predicted == truth.loc[held.index]).mean() >= 0.95
    assert by.predicted[9000] == 1 and by.predicted[9001] == 0
    assert got.score.between(0, 1).all()
    none = toxicity.detect(make(docs[:5]), table.limit(0)).toPandas()
    assert (none.score == 0).all() and len(none) == 5
    assert toxicity.detect(make([]), table).count() == 0


def test_bias_counts_the_windows_trained_on(spark, make, monkeypatch):
    """The clean windows that training adds count in the share that the bias is moved from."""
    rng, seen, ends = random.Random(8), [], []
    step, close = toxicity.AttentionGru.backprop, toxicity.AttentionGru.to_rate
    monkeypatch.setattr(toxicity.AttentionGru, "backprop", lambda self, t, start, length, label: (seen.extend(label), step(self, t, start, length, label))[1])
    monkeypatch.setattr(toxicity.AttentionGru, "to_rate", lambda self, share, rate: (ends.append((share, rate, self.w["bias"][0])), close(self, share, rate))[1])
    docs = [(i, prose(rng, "en", 120, ["vilgrub"] if i % 2 else ()), "en", "h") for i in range(120)]
    table = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(make(docs), table)
    (share, rate, bias), odds = ends[0], lambda p: np.log(p / (1 - p))
    assert share == pytest.approx(np.mean(seen), abs=1e-6) and share < 0.3 and abs(rate - 0.5) < 0.1
    assert model.w["bias"][0] - bias == pytest.approx(odds(rate) - odds(np.mean(seen)), abs=1e-3)


def test_toxicity_driver_gets_windows_only(spark, make, monkeypatch):
    """However long the sampled texts are, the driver learns from three windows a document."""
    rng, seen, cut = random.Random(9), [], toxicity.tile
    monkeypatch.setattr(toxicity, "tile", lambda batch: (seen.append(cut(batch)), seen[-1])[1])
    docs = [(i, prose(rng, "en", 3000, ["vilgrub"] * 40 if i % 2 else ()), "en", "h") for i in range(30)]
    model = toxicity.fit(make(docs), spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int"))
    assert model is not None and len(seen) == toxicity.ROUNDS and toxicity.PER_CLASS == 1600
    assert all(t.n_words.max() <= toxicity.WINDOW and len(t) <= 3 * len(docs) for t in seen)


def test_repeated_rows_are_sampled_once(spark, make, monkeypatch):
    """A hot or null id does not fill the training samples, nor come to the driver row by row."""
    rng, seen = random.Random(10), {}
    hot, null = prose(rng, "en", 30), prose(rng, "en", 30)
    docs = [(i, prose(rng, "en", 30, ["vilgrub"] if i % 2 else ()), "en", "h") for i in range(24)]
    table = spark.createDataFrame([(i, i % 2, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")
    free = langid.fold(langid.PARTS) != langid.HELD
    ids = [r.doc_id for r in spark.range(24).withColumnRenamed("id", "doc_id").where(free & (langid.fold(3) != 1)).collect()]
    docs = make(docs + [(ids[0], hot, "en", "h")] * 200 + [(None, null, "en", "h")] * 200)
    spy = lambda of, name, size: monkeypatch.setattr(of, name, lambda *a, f=getattr(of, name): (seen.setdefault(f"{of.__name__}.{name}", size(a[0])), f(*a))[1])
    spy(langid, "tile", lambda batch: batch.num_rows)
    spy(quality, "learn", len)
    spy(toxicity, "_counted", lambda rows: rows.count())
    langid.fit(docs)
    quality.classify(docs, table)
    toxicity.fit(docs, table)
    assert len(seen) == 3 and max(seen.values()) <= 26, seen


def test_windows_overlap_and_cover():
    import pyarrow as pa

    from velado.llm.words import tile

    t = tile(pa.RecordBatch.from_pydict({"text": [None, "a", " ".join("b" * 48), " ".join("c" * 49), " ".join("d" * 200)]}))
    start, length, doc = toxicity.windows(t)
    for d in range(len(t)):
        words = {w for s, n in zip(start[doc == d], length[doc == d]) for w in range(s, s + n)}
        assert words == set(range(t.first[d], t.first[d + 1]))


def test_quality_held_out(spark, make):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        bad, text = i % 3, prose(rng, "en", rng.randint(20, 120))
        text = {0: text, 1: text, 2: text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", "%%% ")}[bad]
        docs.append((i, text, "en", "h"))
        labels.append((i, int(bad != 2), 0))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(make(docs + EDGE), table).toPandas()
    assert len(got) == len(docs) + len(EDGE) and got.score.between(0, 1).all()
    truth = pd.Series({i: q for i, q, _ in labels})
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    held = by[by.held_out & by.index.isin(truth.index) & (by.index > 10)]
    assert (held.predicted == truth.loc[held.index]).mean() >= 0.95
    none = quality.classify(make(docs[:5]), table.limit(0)).toPandas()
    assert (none.score == 0.5).all()
    assert quality.classify(make([]), table).count() == 0


def test_rules_as_columns_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 4] > 0.5) & (x[:, 7] <= 0.6) | (x[:, 0] > 0.9)).astype(int)
    model = quality.learn(x, y)
    frame = spark.createDataFrame(pd.DataFrame(x, columns=quality.STATS))
    got = np.array([r[0] for r in frame.select(model.score()).collect()])
    want = gru.sigmoid(model.intercept + sum(w * quality._fires(r, x) for r, w in model.rules))
    assert np.allclose(got, want) and ((got > 0.5) == y).mean() > 0.95
    assert 0 < len(model.rules) < 200
