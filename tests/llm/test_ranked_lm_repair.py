"""Ranked search, the language model and conversation repair against brute force and DuckDB."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from velado.llm import ngramlm, oracles, ranked, repair

from .conftest import EDGE

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_rank(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(w), len(w)) for i, t, *_ in docs if (w := terms(t))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 75 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("postings,query_bytes", [(1 << 22, 1 << 22), (400, 300)])
def test_ranking_is_brute_forces(spark, make, postings, query_bytes):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))).upper() if i % 3 else None, "en", "h") for i in range(150)]
    docs += docs[10:14] * 3 + EDGE + [(900, "every_term-apart.here w1", "en", "h")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "unknown"), (93, "w1 w1 W1"), (93, "the"), (None, "one")]
    table = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, doc_id string, n int")
    got = ranked.rank(make(docs), table, k=7, block_postings=postings, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute_rank(docs, items, 7)))


def test_ranking_without_rows(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert ranked.rank(make(EDGE), none).count() == 0 and ranked.rank(make([]), some).count() == 0
    assert ranked.rank(make([(1, None, "en", "h"), (2, " .", "en", "h")]), some).count() == 0


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(5)
    n = 3000
    tf = [(d, t, int(rng.integers(1, 5))) for t in range(6) for d in np.flatnonzero(rng.random(n) < (0.002, 0.01, 0.3, 0.5, 0.7, 0.9)[t])]
    tf.sort()
    doc, term, count = (np.array(x) for x in zip(*tf))
    first = np.searchsorted(doc, np.arange(n + 1))
    block = ranked.Block(np.arange(n), rng.integers(5, 90, n), first, term, count, n, 50 * n, 6)
    weight = np.array([7000, 5000, 1100, 600, 300, 90])
    every = np.zeros(n, np.int64)
    for t in range(6):
        a, b = block.first[t], block.first[t + 1]
        every[block.doc[a:b]] += weight[t] * block.part[a:b]
    best = np.lexsort((np.arange(n), -every))[:10]
    for floor in (0, int(every[best[-1]]), int(every[best[3]])):
        found, score = block.search(np.arange(6), weight, 10, floor)
        assert (score == every[found]).all()
        assert {int(d) for d in best if every[d] >= floor} <= {int(d) for d in found}
    found, _ = block.search(np.arange(6), weight, 10, 0)
    assert len(found) < 100  # ties aside, most documents never got an accumulator


def brute_lm(train, text, order):
    start, end = object(), object()
    seq = lambda t: [start, *WORD.findall((t or "").translate(LOWER)), end]
    raw = [Counter() for _ in range(order + 1)]
    for t in train:
        s = seq(t)
        for k in range(1, order + 1):
            for i in range(max(k - 1, 1), len(s)):
                raw[k][tuple(s[i - k + 1 : i + 1])] += 1
    adj = [None] * (order + 1)
    adj[order] = raw[order]
    for k in range(order - 1, 0, -1):
        adj[k] = Counter()
        for g in adj[k + 1]:
            adj[k][g[1:]] += 1
        for g, c in raw[k].items():
            if g[0] is start:
                adj[k][g] = c
    words = len(raw[1])
    disc = [None] * (order + 1)
    for k in range(1, order + 1):
        n = [sum(c == j for c in adj[k].values()) for j in range(1, 5)]
        d = [0.5, 1.0, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            own = [j + 1 - (j + 2) * y * n[j + 1] / n[j] for j in range(3)]
            d = own if all(0 < x <= j + 1 for j, x in enumerate(own)) else d
        disc[k] = [0.0, *d]
    below = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in adj[k].items():
            below[k][g[:-1]].append(c)

    def prob(g):
        k = len(g)
        low = prob(g[1:]) if k > 1 else 1 / (words + 1)
        counts = below[k].get(g[:-1])
        if not counts:
            return low
        c = adj[k].get(g, 0)
        return ((c - disc[k][min(c, 3)]) + sum(disc[k][min(x, 3)] for x in counts) * low) / sum(counts)

    s = seq(text)
    score = sum(math.log10(prob(tuple(s[max(0, i - order + 1) : i + 1]))) for i in range(1, len(s)))
    n = sum(raw[1].values())
    base = sum(math.log10((raw[1][(w,)] + 1) / (n + words + 1)) for w in s[1:])
    total = sum(prob((w,)) for w, in raw[1]) + prob((object(),))
    after = s[max(0, len(s) - order) : -1]
    one = sum(prob((*after, w)) for w, in raw[1]) + prob((*after, object()))
    return len(s) - 1, sum(raw[1][(w,)] > 0 for w in s[1:]), n, base, score, (total, one)


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_brute_forces(make, order, monkeypatch):
    monkeypatch.setattr(ngramlm, "SHARD_ROWS", 64)
    rng = random.Random(order)
    docs = [(i, None if i % 19 == 4 else " ".join(rng.choice("aAbcdefg") + rng.choice("xy") for _ in range(rng.randint(0, 30))), "en", "h") for i in range(60)]
    docs += docs[:2] + EDGE[:5] + [EDGE[8], (77, "never seen words", "en", "h"), (None, "ax bx", "en", "h")]
    train = [t for i, t, *_ in docs if not _held(i)]
    got = ngramlm.perplexity(make(docs), order)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    want = []
    for i, t, *_ in docs:
        size, known, n, base, score, sums = brute_lm(train, t, order)
        assert all(abs(x - 1) < 1e-9 for x in sums)
        want.append((str(i), _held(i), size, known, n, round(base, 6), round(score, 6)))
    assert have == sorted(want)


def test_model_edges(make):
    assert ngramlm.perplexity(make([])).count() == 0
    held = next(i for i in range(100) if _held(i))
    (row,) = ngramlm.perplexity(make([(held, "alone here", "en", "h")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    wide = ngramlm.perplexity(make([(i, t, "en", "h") for i, (_, t, *_) in enumerate(EDGE)]))
    assert wide.count() == len(EDGE)


def test_keys_are_sparks(spark):
    rows = [(0, -1), (2**63 - 1, -(2**63)), (12345, 678)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a"), F.xxhash64("a", "b")).collect()]
    a, b = (np.array(c) for c in zip(*rows))
    assert got == list(zip(ngramlm.xxhash64([a]).tolist(), ngramlm.xxhash64([a, b]).tolist()))


def brute_repair(rows):
    """Least (cost, audit) over all edit strings, by exhaustive search with at most two inserts in a place."""
    best = None
    for n_in in itertools.product(range(3), repeat=len(rows) + 1):
        for choice in itertools.product("DKR", repeat=len(rows)):
            cost, audit, state, ok = 0, "", repair.EMPTY, True
            for i in range(len(rows) + 1):
                for _ in range(n_in[i]):
                    cost, audit, state = cost + 5, audit + "I", repair.STEP[state, repair.NEXT[state]]
                if i == len(rows):
                    break
                role, fault = rows[i]
                audit += choice[i]
                if choice[i] == "D":
                    cost += 2
                    continue
                if fault == "b" or choice[i] == "K" and (state, role) not in repair.STEP:
                    ok = False
                    break
                cost += (choice[i] == "R") + 5 * (fault == "t")
                state = repair.STEP[state, role if choice[i] == "K" else repair.NEXT[state]]
            if ok and state in repair.ENDS and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_least_paths_are_exhaustive():
    rng = random.Random(7)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice("--tb")) for _ in range(rng.randint(0, 4))]
        assert repair.repair("".join(r + f for r, f in rows)) == brute_repair(rows)


@pytest.mark.parametrize("cut,fold", [(1, 2), (3, 2), (5, 3)])
def test_chains_equal_whole_lattices(monkeypatch, cut, fold):
    monkeypatch.setattr(repair, "FOLD", fold)
    rng = random.Random(cut)
    for _ in range(60):
        codes = "".join(rng.choice("suax") + rng.choice("---tb") for _ in range(rng.randint(1, 25)))
        held = [{"codes": codes[i : i + 2 * cut]} for i in range(0, len(codes), 2 * cut)]
        run = repair._Run((False, 1), held + [])
        cost = repair.solve(run, repair.EMPTY, repair.ENDS, True)
        assert (cost, "".join(s["audit"] for s in held)) == repair.repair(codes)


def talks(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 9)):
            text = rng.choice(["Hello there.", "yes", "No!", " \t", "", "long answer " * rng.randint(1, 9) + "?", None, "été…", "Hello there."])
            rows.append((c, t * rng.randint(1, 2) if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), text))
    return rows


@pytest.mark.parametrize("task_rows,segment", [(50_000, 256), (40, 4)])
def test_reports_are_the_oracles(spark, monkeypatch, task_rows, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(11)
    rows = talks(rng, 60) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Bye"), (None, None, None, None)]
    rows += [(500, t, ("user", "assistant")[t % 2], rng.choice(["a.", "b", f"c{t}?"])) for t in range(300)] + [(501, 3, "user", "same.")] * 40
    rows += [(600 + i, 0, "user", "x") for i in range(60)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, none string").repartition(3)
    got = repair.repair_report(table, task_rows)
    con = duckdb.connect()
    con.register("conversations", table.toPandas()[["conv_id", "turn", "role", "text"]].astype({"conv_id": "Int64", "turn": "Int64"}).convert_dtypes())
    res = con.execute(oracles.OP13)
    names = [d[0] for d in res.description]
    assert got.columns == names
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, res.fetchall()))


def test_repaired_rows_keep_the_law(spark):
    rng = random.Random(4)
    table = spark.createDataFrame(talks(rng, 40), "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for r in repair.repaired_rows(table).collect():
        found[r.conv_id].append((r.place, r.role, r.text))
    for rows in found.values():
        initials = "".join(r[:1] for _, r, _ in sorted(rows))
        assert re.fullmatch("(s?(ua)+)?", initials)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired_rows(empty).count() == 0 and repair.repair_report(empty).count() == 0
    (one,) = repair.repair_report(spark.createDataFrame([(9, 0, "user", "")], "conv_id long, turn long, role string, text string")).collect()
    assert (one.cost, one.audit, one.repaired_sha256) == (2, "D", hashlib.sha256(b"").hexdigest())
