"""Operator 13, conversation structure repair: bidirectional Dijkstra over the edit lattice.

Rows get their faults in Spark and are range-sorted by conversation and turn, so a conversation of any length is spread
over the tasks that its rows fill. Each task reads its rows as a stream and cuts them into segments of bounded rows
and bytes. A node of the lattice is (rows consumed, state); the states follow ``(s?(ua)+)?``. A forward heap from the
start and a reverse heap from the ends settle nodes by cost; they go on until their two least costs together exceed
the best meeting, so every crossing of equal cost is there, and the least concatenated audit is picked.

A conversation of several segments is solved segment by segment between all entry and exit states (at most 16 paths
each). The chain of segments is a lattice of the same kind, whose labels are the ranks of the segments' audits; long
chains are folded until one step is left, and the chosen states go back down. Of a conversation that runs over the
border of a task, each task hands on one row of such costs and ranks; these few rows meet in one group.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise
from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velado.llm.util import small_batches, stored

#: Rows and text bytes of a segment, segments of a fold, rows and text bytes of a task.
SEGMENT, SEGMENT_BYTES, FOLD, TASK_ROWS, TASK_BYTES = 256, 1 << 20, 256, 50_000, 32 << 20
SPACES = " \t\n\x0b\f\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or reassigned row must have in a state.
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ENDS = (EMPTY, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
Node = tuple[int, int]
#: Cost and label string between an entry and an exit state.
Paths = dict[tuple[int, int], tuple[int, str]]


def least_path(start: Node, goals: Iterable[Node], after: Callable, before: Callable) -> tuple[int, str] | None:
    """Least cost from ``start`` to one of ``goals``, and the least label string among the paths of that cost.

    ``after(node)`` and ``before(node)`` give ``(node, label, cost)`` of the edges that leave and enter a node. An edge
    without cost must lead to a higher first component, so that nodes of equal cost settle in that order.
    """
    forward, reverse = {start: (0, "")}, {g: (0, "") for g in goals}
    ahead, back = [(0, start[0], start)], [(0, -g[0], g) for g in reverse]
    done: tuple[dict, dict] = ({}, {})
    best = 0 if start in reverse else None

    def settle(heap: list, labels: dict, mine: dict, edges: Callable, sign: int) -> None:
        nonlocal best
        cost, _, node = heappop(heap)
        if node in mine or cost > labels[node][0]:
            return
        mine[node] = labels[node]
        text = labels[node][1]
        other = reverse if sign > 0 else forward
        for to, label, price in edges(node):
            new = (cost + price, text + label if sign > 0 else label + text)
            if to not in mine and (to not in labels or new < labels[to]):
                if to not in labels or new[0] < labels[to][0]:
                    heappush(heap, (new[0], sign * to[0], to))
                labels[to] = new
            if to in other and (best is None or new[0] + other[to][0] < best):
                best = new[0] + other[to][0]

    while ahead and back and (best is None or ahead[0][0] + back[0][0] <= best):
        if ahead[0][0] <= back[0][0]:
            settle(ahead, forward, done[0], after, 1)
        else:
            settle(back, reverse, done[1], before, -1)
    if best is None:
        return None
    # On the least path a settled node is followed by one that the other side has settled, so both have its labels.
    found = [text + reverse[v][1] for v, (cost, text) in forward.items() if v in reverse and cost + reverse[v][0] == best]
    return best, min(found)


def edits(rows: str, closed: bool) -> tuple[Callable, Callable]:
    """Edges of the lattice of a segment. ``rows`` has two characters a row: role initial, and ``b`` (must go), ``t``
    (truncated) or ``-``. Rows are inserted before a row, and after the last one only where the segment is ``closed``."""
    n = len(rows) // 2

    def after(node: Node) -> list[tuple[Node, str, int]]:
        i, q = node
        out = []
        if i < n or closed:
            out.append(((i, STEP[q, NEXT[q]]), "I", INSERT))
        if i < n:
            role, fault = rows[2 * i], rows[2 * i + 1]
            out.append(((i + 1, q), "D", DELETE))
            if fault != "b":
                more = TRUNCATED if fault == "t" else 0
                out.append(((i + 1, STEP[q, NEXT[q]]), "R", REROLE + more))
                if (q, role) in STEP:
                    out.append(((i + 1, STEP[q, role]), "K", KEEP + more))
        return out

    def before(node: Node) -> list[tuple[Node, str, int]]:
        i, to = node
        near = [(i, q) for q in range(4)] + [(i - 1, q) for q in range(4) if i]
        return [(v, label, price) for v in near for w, label, price in after(v) if w == node]

    return after, before


@lru_cache(1 << 16)
def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    n = len(rows) // 2
    found = least_path((0, EMPTY), [(n, q) for q in ENDS], *edits(rows, True))
    assert found is not None  # deleting every row is a repair
    return found


@lru_cache(1 << 12)
def segment(rows: str, closed: bool = False) -> Paths:
    """Cost and audit between all entry and exit states of a segment that have a path."""
    edges, n = edits(rows, closed), len(rows) // 2
    found = {(p, q): least_path((0, p), [(n, q)], *edges) for p in range(4) for q in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def chain(parts: list[Paths]) -> tuple[Callable, Callable]:
    """Edges of the lattice whose steps are whole parts, labelled by one character each: their label strings' ranks."""
    ranks = [{t: chr(97 + r) for r, t in enumerate(sorted({t for _, t in p.values()}))} for p in parts]

    def after(node: Node) -> list[tuple[Node, str, int]]:
        i, p = node
        if i == len(parts):
            return []
        return [((i + 1, q), ranks[i][parts[i][p, q][1]], parts[i][p, q][0]) for q in range(4) if (p, q) in parts[i]]

    def before(node: Node) -> list[tuple[Node, str, int]]:
        return [((node[0] - 1, p), label, price) for p in range(4) if node[0] for to, label, price in after((node[0] - 1, p)) if to == node]

    return after, before


def fold(parts: list[Paths]) -> Paths:
    """The parts as one: least costs and rank strings between all states, over chains of at most FOLD at a time."""
    while len(parts) > 1:
        runs = [parts[i : i + FOLD] for i in range(0, len(parts), FOLD)]
        parts = []
        for run in runs:
            edges = chain(run)
            found = {(p, q): least_path((0, p), [(len(run), q)], *edges) for p in range(4) for q in range(4)}
            parts.append({k: v for k, v in found.items() if v is not None})
    return parts[0]


def route(parts: list[Paths], enter: int, leave: Iterable[int]) -> tuple[int, list[int]]:
    """Least cost through the parts, and the states at their borders on the path with the least labels."""
    leave = tuple(leave)
    if len(parts) <= FOLD:
        after, before = chain(parts)
        found = least_path((0, enter), [(len(parts), q) for q in leave], after, before)
        assert found is not None  # deleting every row is a path from each state to itself
        states = [enter]
        for i, label in enumerate(found[1]):
            # From one state, a label string leads to one state.
            states.append(next(to[1] for to, have, _ in after((i, states[-1])) if have == label))
        return found[0], states
    runs = [parts[i : i + FOLD] for i in range(0, len(parts), FOLD)]
    cost, borders = route([fold(r) for r in runs], enter, leave)
    states = [enter]
    for run, (p, q) in zip(runs, pairwise(borders)):
        states += route(run, p, [q])[1][1:]
    return cost, states


TAIL = segment("", True)
#: A piece of a conversation that a task hands on, one column for each pair of states.
_PAIRS = [(p, q) for p in range(4) for q in range(4)]


def ranked(paths: Paths) -> Paths:
    """Label strings replaced by one character, their rank."""
    rank = {t: chr(97 + r) for r, t in enumerate(sorted({t for _, t in paths.values()}))}
    return {k: (cost, rank[t]) for k, (cost, t) in paths.items()}


def illegal_pairs(initials: Iterable[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))


@dataclass
class _Run:
    """Segments of one conversation in one task."""

    conv: tuple[bool, int | None]
    segments: list[dict] = field(default_factory=list)


_SEGMENT = "part int, num int, codes string, roles array<string>, texts array<string>, enter int, audit string, cost long, illegal long"


def solve(run: _Run, enter: int, leave: Iterable[int], tail: bool) -> int:
    """Set ``enter`` and ``audit`` of the run's segments; the least cost. ``tail``: the conversation ends here."""
    if tail and enter == EMPTY and len(run.segments) == 1:
        cost, audit = repair(run.segments[0]["codes"])
        run.segments[0] |= {"enter": EMPTY, "audit": audit}
        return cost
    parts = [segment(s["codes"]) for s in run.segments] + [TAIL] * tail
    cost, states = route(parts, enter, leave)
    for s, paths, (p, q) in zip(run.segments, parts, pairwise(states)):
        s |= {"enter": p, "audit": paths[p, q][1]}
    if tail:
        run.segments[-1]["audit"] += TAIL[states[-2], states[-1]][1]
    return cost


def _cut(kind: str):
    """Sorted rows into segments; conversations that touch neither end of the task's rows are solved here."""

    def runs(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[_Run]:
        run, rows, size = None, [], 0

        def close() -> None:
            nonlocal rows, size
            if rows:
                roles, texts, marks = (list(x) for x in zip(*rows))
                codes = "".join((r[:1] or " ") + m for r, m in zip(roles, marks))
                run.segments.append({"part": part, "num": len(run.segments), "codes": codes, "roles": roles, "texts": texts})
            rows, size = [], 0

        for batch in batches:
            names = ("none", "conv", "role", "text", "mark")
            for none, conv, role, text, mark in zip(*(batch.column(c).to_pylist() for c in names)):
                if run is None or run.conv != (none, conv):
                    if run is not None:
                        close()
                        yield run
                    run = _Run((none, conv))
                if len(rows) >= SEGMENT or size and size + len(text) > SEGMENT_BYTES:
                    close()
                rows.append((role, text, mark))
                size += len(text)
        if run is not None:
            close()
            yield run

    def out(run: _Run, cost: int | None) -> Iterator[pa.RecordBatch]:
        last = ""
        for i, s in enumerate(run.segments):
            initials = s["codes"][::2]
            s |= {"illegal": illegal_pairs(last + initials), "cost": cost if i == 0 else None}
            last = initials[-1]
        step = max(1, (8 << 20) // SEGMENT_BYTES)
        names = ["none", "conv", *(c.split()[0] for c in _SEGMENT.split(", "))]
        types = [pa.bool_(), pa.from_numpy_dtype("int64") if kind == "bigint" else pa.int32() if kind == "int" else pa.string()]
        types += [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for i in range(0, len(run.segments), step):
            held = [{"none": run.conv[0], "conv": run.conv[1]} | s for s in run.segments[i : i + step]]
            yield pa.RecordBatch.from_arrays([pa.array([h.get(n) for h in held], t) for n, t in zip(names, types)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = runs(batches, TaskContext.get().partitionId())
        first, held = True, None
        for run in found:
            if held is not None:
                yield from out(held, None if first else solve(held, EMPTY, ENDS, True))
                first = False
            held = run
        if held is not None:
            yield from out(held, None)

    return work


def conv_key() -> list[Column]:
    """A conversation's key, null included."""
    return [F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("conv")]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the contract's damage, chosen by crc32 of ``conv_id:turn`` modulo 20 (0 drops
    the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets the role user); nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                                (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("hurt"))
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("hurt <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "hurt")
    return rows.withColumn("copy", F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hurt", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with their key, their place ``turn, role, hash, uid`` (equal turns by role and text) and ``fault``: blank,
    duplicate or truncated, or null. Copies are told by role and MD5 of the text, so no group of rows is collected."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(*conv_key(), "turn", space("role").alias("role"), space("text").alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = stored(rows.withColumns({"hash": F.md5("text"), "uid": F.monotonically_increasing_id(), "empty": bare == "",
                                    "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")}))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    key = ["none", "conv0", "role", "hash"]
    rows = rows.withColumn("conv0", F.coalesce("conv", F.lit(0)))
    first = rows.where("not empty").groupBy(*key).agg(F.min(place).alias("first"))
    marked = rows.join(first, key, "left")
    fault = F.when(F.col("empty"), "blank").when(place > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return marked.select("none", "conv", "turn", "role", "text", "hash", "uid", fault.alias("fault"))


def segments(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Solved segments of all conversations: key (``none``, ``conv``), place (``part``, ``num``), the rows' codes, roles and
    texts, the state that they are entered in, their audit, the conversation's cost (on its first segment), and illegal
    neighbours. ``rows`` come from ``faults``."""
    spark = rows.sparkSession
    small_batches(spark)
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // task_rows), -(-(size or 0) // TASK_BYTES))
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "b").when(F.col("fault") == "truncated", "t").otherwise("-")
    order = ["none", "conv", F.asc_nulls_first("turn"), "role", "hash", "uid"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"none boolean, conv {kind}, {_SEGMENT}"
    cut = stored(dealt.select("none", "conv", "role", "text", mark.alias("mark")).mapInArrow(_cut(kind), schema))

    # Conversations at the borders of tasks: a piece a task, their few pieces together, and back to the segments.
    edge = cut.where("audit is null")
    lists = lambda g: sorted(g.to_pylist(), key=lambda r: (r["part"], r.get("num", 0)))

    def piece(table: pa.Table) -> pa.Table:
        held = lists(table)
        paths = ranked(fold([segment(r["codes"]) for r in held]))
        cells = [f"{paths[x][0]} {paths[x][1]}" if x in paths else "" for x in _PAIRS]
        row = {"none": held[0]["none"], "conv0": held[0]["conv0"], "part": held[0]["part"], "paths": cells,
               "first": held[0]["codes"][:1], "last": held[-1]["codes"][-2:-1]}
        return pa.Table.from_pylist([row], pa.schema([("none", pa.bool_()), ("conv0", pa.string()), ("part", pa.int32()), ("paths", pa.list_(pa.string())),
                                                      ("first", pa.string()), ("last", pa.string())]))

    def meet(table: pa.Table) -> pa.Table:
        held, out = lists(table), []
        parts = [{x: (int(c.split()[0]), c.split()[1]) for x, c in zip(_PAIRS, r["paths"]) if c} for r in held]
        cost, states = route([*parts, TAIL], EMPTY, ENDS)
        borders = [0] + [illegal_pairs((a["last"], b["first"])) for a, b in pairwise(held)]
        for i, (r, (p, q)) in enumerate(zip(held, pairwise(states))):
            tail = i == len(held) - 1
            out.append({k: r[k] for k in ("none", "conv0", "part")} | {"p": p, "q": q, "last_state": states[-1] if tail else None, "total": cost if i == 0 else None, "border": borders[i]})
        return pa.Table.from_pylist(out, pa.schema([("none", pa.bool_()), ("conv0", pa.string()), ("part", pa.int32()), ("p", pa.int32()), ("q", pa.int32()),
                                                    ("last_state", pa.int32()), ("total", pa.int64()), ("border", pa.int64())]))

    def settle(mine: pa.Table, states: pa.Table) -> pa.Table:
        held, (state,) = lists(mine), states.to_pylist()
        run = _Run((False, None), held)
        solve(run, state["p"], [state["q"]], False)
        if state["last_state"] is not None:
            held[-1]["audit"] += TAIL[state["q"], state["last_state"]][1]
        out = [{"none": r["none"], "conv0": r["conv0"], "part": r["part"], "num": r["num"], "p": r["enter"], "found": r["audit"],
                "total": state["total"] if i == 0 else None, "border": state["border"] if i == 0 else 0} for i, r in enumerate(held)]
        return pa.Table.from_pylist(out, pa.schema([("none", pa.bool_()), ("conv0", pa.string()), ("part", pa.int32()), ("num", pa.int32()), ("p", pa.int32()),
                                                    ("found", pa.string()), ("total", pa.int64()), ("border", pa.int64())]))

    conv0 = F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv0")
    bare = edge.select("none", conv0, "part", "num", "codes")
    pieces = bare.groupBy("none", "conv0", "part").applyInArrow(piece, "none boolean, conv0 string, part int, paths array<string>, first string, last string")
    states = stored(pieces.groupBy("none", "conv0").applyInArrow(meet, "none boolean, conv0 string, part int, p int, q int, last_state int, total long, border long"))
    keys = ["none", "conv0", "part"]
    solved = bare.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(settle, "none boolean, conv0 string, part int, num int, p int, found string, total long, border long")
    late = edge.withColumn("conv0", conv0).drop("enter", "audit", "cost").join(solved, [*keys, "num"])
    done = late.select("none", "conv", "part", "num", "codes", "roles", "texts", F.col("p").alias("enter"), F.col("found").alias("audit"),
                       F.col("total").alias("cost"), (F.col("illegal") + F.col("border")).alias("illegal"))
    return stored(cut.where("audit is not null").unionByName(done))


def repaired(codes: str, roles: list[str], texts: list[str], enter: int, audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that a segment's audit leaves or makes."""
    state, i = enter, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        need = NEXT[state]
        name = roles[i] if edit == "K" else {"u": "user", "a": "assistant"}[need]
        state = STEP[state, codes[2 * i] if edit == "K" else need]
        yield name, "" if edit == "I" else texts[i]
        i += edit != "I"


_REPAIR = ("codes", "roles", "texts", "enter", "audit")


def repaired_rows(conversations: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``conv_id, place, role, text``: the rows of every repaired conversation, in the order of ``place`` (any numbers).

    Rows are taken by turn (nulls first, equal turns by role and text). Nulls in role or text count as one space; a null
    conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
    """
    found = segments(stored(faults(conversations)), task_rows)
    kind = found.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, num, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "num", *_REPAIR))):
                rows = list(repaired(*rest))
                place = [((part << 24) + num << 12) + i for i in range(len(rows))]
                arrays = [pa.array([conv] * len(rows), batch.schema.field("conv").type), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["conv_id", "place", "role", "text"])

    return found.select("conv", "part", "num", *_REPAIR).mapInArrow(work, f"conv_id {kind}, place long, role string, text string")


def digests(found: DataFrame) -> DataFrame:
    """``none, conv, cost, illegal, audit, repaired_sha256`` of each conversation. Its segments pass one task as a sorted
    stream; of the texts only the running hash is kept, of the edits one character each."""
    kind = found.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            types = [pa.bool_(), arrow, pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["none", "conv", "cost", "illegal", "audit", "repaired_sha256"])

        def close() -> None:
            if key is not None:
                out.append((*key, state["cost"], state["illegal"], "".join(state["audit"]), state["hash"].hexdigest()))

        for batch in batches:
            arrow = batch.schema.field("conv").type
            names = ("none", "conv", "cost", "illegal", *_REPAIR)
            for none, conv, cost, illegal, *rest in zip(*(batch.column(c).to_pylist() for c in names)):
                if key != (none, conv):
                    close()
                    key, state = (none, conv), {"cost": 0, "illegal": 0, "audit": [], "hash": hashlib.sha256(), "rows": 0}
                state["cost"] += cost or 0
                state["illegal"] += illegal
                state["audit"].append(rest[-1])
                for role, text in repaired(*rest):
                    state["hash"].update((("\n" if state["rows"] else "") + f"{role}:{text}").encode())
                    state["rows"] += 1
            if len(out) >= 1000:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    run = found.select("none", "conv", "part", "num", "cost", "illegal", *_REPAIR)
    run = run.repartition(F.col("none"), F.col("conv")).sortWithinPartitions("none", "conv", "part", "num").drop("part", "num")
    return run.mapInArrow(work, f"none boolean, conv {kind}, cost long, illegal long, audit string, repaired_sha256 string")


def repair_report(conversations: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row for every conv_id of the table: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of its rows after damage.

    A null conv_id is a conversation of its own. Conversations without rows after damage have zeros, an empty audit and
    the hash of an empty text. Repeated rows are rows of their own (later ones are duplicates); the order of equal turns
    is by role and text. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(faults(damaged(conversations)))
    counts = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    turns = rows.groupBy("none", "conv", "turn").agg(*counts)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = turns.groupBy("none", "conv").agg(gaps, *(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")))
    texts = digests(segments(rows, task_rows))
    every = conversations.select(*conv_key()).distinct()
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    out = every.join(facts, same(every, facts), "left").join(texts, same(every, texts), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(every["conv"].alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
