"""Substring dedup and the Jaccard join against brute force over all windows and all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from velado.llm import jaccard, substring
from velado.llm.util import components

from .conftest import EDGE

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_removed(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for t, w in zip(texts, words):
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), None if t is None else " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("letters,k,seed", [(2, 6, 3), (4, 8, 3), (30, 5, 2), (3, 9, 4)])
def test_removed_words_are_brute_forces(make, letters, k, seed):
    rng = random.Random(letters)
    v = [chr(97 + i) for i in range(letters)]
    rows = [(i, None if i % 17 == 3 else " ".join(rng.choice(v) for _ in range(rng.randint(0, 50))), "en", "h") for i in range(80)]
    rows += rows[:3] + EDGE[:6]
    got = substring.remove_repeats(make(rows), k, seed).toPandas()
    want = [(i, *x) for (i, *_), x in zip(rows, brute_removed([r[1] for r in rows], k))]
    have = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_planted_passage_and_edges(make):
    rng = random.Random(1)
    free = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    passage = free(60)
    rows = EDGE + [(100 + i, f"{free(20)}\n{passage} {free(20)}", "en", "h") for i in range(30)] + [(500, free(300), "en", "h")]
    got = substring.remove_repeats(make(rows), keep=("key",)).toPandas()
    want = brute_removed([r[1] for r in rows], 35)
    assert sorted(zip(got.n_words, got.n_removed)) == sorted((a, b) for a, b, _ in want)
    by = got.dropna(subset=["doc_id"]).set_index("doc_id").sort_index()
    assert (by.n_removed.loc[100:129] == 60).all() and by.n_removed[500] == 0 and (by.key == "x").all()
    assert substring.remove_repeats(make([])).count() == 0


def test_spans_of_equal_rows_are_bounded_by_one_document(make):
    rng = random.Random(6)
    text = " ".join(f"{rng.getrandbits(40):x}" for _ in range(60))
    docs = make([(7, text, "en", "h")] * 3000 + [(None, text + " z", "en", "h")] * 2 + [(8, "y " + text[:400], "en", "h")])
    spans = substring.repeated_spans(docs).toPandas()
    assert len(spans) and spans.spans.map(len).max() <= 60
    got = substring.remove_repeats(docs).toPandas()
    assert len(got) == 3003 and (got.n_removed[got.doc_id == 7] == 60).all() and (got.n_removed[got.doc_id.isna()] == 61).all()


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))]


def near_copies(seed):
    rng = random.Random(seed)
    rows = [r for r in EDGE]
    base = [f"w{rng.randint(0, 5000)}" for _ in range(90)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 99)}"
        rows.append((100 + i, " ".join(w) if i % 3 else " ".join(w).upper(), "en", "h"))
    common = " ".join(f"line{j}" for j in range(20))
    rows += [(300 + i, common + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 25))), "en", "h") for i in range(60)]
    rows += [(500 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "en", "h") for i in range(60)]
    return rows


@pytest.mark.parametrize("chunk", [1 << 18, 300])
def test_components_are_brute_forces(make, chunk):
    rows = near_copies(5)
    got = jaccard.jaccard_components(make(rows), chunk_shingles=chunk).toPandas()
    none = lambda x: None if pd.isna(x) else int(x)
    have = [(none(r.doc_id), r.n_shingles, none(r.component_id)) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, brute_components(rows)))


def test_empty_and_one_per_component(make):
    assert jaccard.jaccard_components(make([])).count() == 0
    rows = near_copies(6)
    docs = make(rows)
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    want = {(c, n > 0) for _, n, c in brute_components(rows) if n} | {(i, False) for i, n, _ in brute_components(rows) if not n}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(want) and set(ids) == {c for c, _ in want}


def test_search_skips_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 10**9, 60)
    sets = []
    for _ in range(40):
        s = base.copy()
        s[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 10**9)
        sets.append(np.unique(s))
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = jaccard.search(np.concatenate(sets), off, np.arange(40), np.zeros(40, np.int8)).roots(np.arange(40))
    up = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert (pd.factorize(got)[0] == pd.factorize(np.array(up))[0]).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize("size", [2, 3, 40, 60])
def test_every_family_goes_through_the_lists(size, monkeypatch):
    merges = []
    real = jaccard.merge_skip
    monkeypatch.setattr(jaccard, "merge_skip", lambda lists, least: merges.append(len(lists)) or real(lists, least))
    rng = np.random.default_rng(size)
    base = rng.integers(0, 10**9, 50)
    sets = []
    for _ in range(size):
        s = base.copy()
        s[rng.permutation(50)[: rng.integers(3, 9)]] = rng.integers(0, 10**9, 1)
        sets.append(np.unique(s))
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = jaccard.search(np.concatenate(sets), off, np.arange(size), np.zeros(size, np.int8)).roots(np.arange(size))
    up = np.arange(size)
    links = 0
    for i in range(size):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                up[up == max(up[i], up[j])] = min(up[i], up[j])
    assert (pd.factorize(got)[0] == pd.factorize(up)[0]).all()
    assert merges and (links == 0 or len(merges) >= len(set(up.tolist())) - 1)


def test_merge_skip_counts_all_values():
    rng = random.Random(8)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(1, 8))]
        count = Counter(v for x in lists for v in x)
        for least in range(1, len(lists) + 1):
            want = sorted((v, c) for v, c in count.items() if c >= least)
            assert list(zip(*jaccard.merge_skip(lists, least))) == want


def test_common_shingles_by_sums_or_by_windows(spark, make):
    docs = make(near_copies(9))
    posted = jaccard.postings(docs)
    few, many = (sorted(tuple(r) for r in jaccard.short_lists(posted, least=n).collect()) for n in (2, 10**9))
    assert few == many and few


def test_digests_that_always_clash_raise(make, monkeypatch):
    monkeypatch.setattr(jaccard, "set_digests", lambda h, off: (np.zeros(len(off) - 1, np.int64), h[off[:-1]].astype(np.int64)))
    with pytest.raises(RuntimeError):
        jaccard.linked_rows(make([(1, "a b c", "en", "h"), (2, "d e f", "en", "h")]))
