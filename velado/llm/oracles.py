"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS k FROM i),
c AS (SELECT *, k IS NOT NULL AND count(k) OVER (PARTITION BY k) > 1 AS twice FROM k),
g AS (SELECT *, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM c),
s AS (SELECT r, sum(gone::INT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.r = d.r"""

OP3 = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM x),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.r = d.r
JOIN (SELECT reach.a, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.b GROUP BY reach.a) m ON m.a = d.r"""

OP10 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, i, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i:i + 4], ' ') END AS k FROM i),
c AS (SELECT r, i, k IS NOT NULL AND count(k) OVER (PARTITION BY r, k) > 1 AS twice FROM k),
g AS (SELECT r, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM c),
rep AS (SELECT r, sum(inside) AS n FROM g GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN l ON l.r = d.r LEFT JOIN rep ON rep.r = d.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS x FROM f GROUP BY source),
m AS (SELECT least(greatest(avg(x / n), 0.0001), 0.9999) AS m, var_pop(x / n) AS v, avg(1.0 / n) AS inv FROM h),
q AS (SELECT m, v - m * (1 - m) * inv AS spread FROM m),
p AS (SELECT m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1000.0) ELSE 1000.0 END AS weight FROM q),
rate AS (SELECT source, (x + m * weight) / (n + weight) AS rate, n + weight + 1 AS size FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate - 1.645 * sqrt(rate * (1 - rate) / size) <= 0.5 AS kept
FROM f JOIN rate ON rate.source IS NOT DISTINCT FROM f.source"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY t, docs),
q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY i, item_id, t),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * docs) // len) AS m FROM n, total),
s AS (SELECT i, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM k WHERE k <= 20"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: {step}), 4294967295)"


def _discounts(name: str, source: str, count: str) -> str:
    """Three discounts by counts of counts; fixed ones where those give none."""
    n = ", ".join(f"count(*) FILTER (WHERE {count} = {k})::DOUBLE AS n{k}" for k in (1, 2, 3, 4))
    own = [f"{k} - {k + 1} * n1 / (n1 + 2 * n2) * n{k + 1} / n{k}" for k in (1, 2, 3)]
    fine = " AND ".join(f"n{k} > 0" for k in (1, 2, 3, 4))
    inside = " AND ".join(f"d{k} > 0 AND d{k} <= {k}" for k in (1, 2, 3))
    return f"""{name}_n AS (SELECT {n} FROM {source}),
{name}_d AS (SELECT {', '.join(f'CASE WHEN {fine} THEN {x} END AS d{k + 1}' for k, x in enumerate(own))} FROM {name}_n),
{name} AS (SELECT CASE WHEN {inside} THEN [d1, d2, d3] ELSE [0.5::DOUBLE, 1::DOUBLE, 1.5::DOUBLE] END AS d FROM {name}_d)"""


def _spare(prefix: str, d: str) -> str:
    return f"({d}[1] * {prefix}1 + {d}[2] * {prefix}2 + {d}[3] * {prefix}3)"


_COUNTS = "sum(c) AS total, count(*) FILTER (WHERE c = 1) AS k1, count(*) FILTER (WHERE c = 2) AS k2, count(*) FILTER (WHERE c > 2) AS k3"
OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out,
             list_concat([' start'], regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), [' end']) AS w FROM documents),
i AS (SELECT r, held_out, w, unnest(range(2, len(w) + 1)) AS i FROM d),
t AS (SELECT r, held_out, w[i - 1] AS v, w[i] AS w FROM i),
uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
g AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS words FROM uni),
bi AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
one AS (SELECT w, count(*) AS c FROM bi GROUP BY w),
{_discounts("da", "one", "c")},
{_discounts("db", "bi", "c")},
ctx AS (SELECT v, {_COUNTS} FROM bi GROUP BY v),
low AS (SELECT {_COUNTS} FROM one),
p AS (SELECT t.r, uni.c AS known, g.n, g.words, ctx.total, bi.c AS c2, db.d AS db, ctx.k1, ctx.k2, ctx.k3,
             CASE WHEN low.total IS NULL THEN 1.0 ELSE ({_spare("low.k", "da.d")} / (g.words + 1) + coalesce(one.c - da.d[least(one.c, 3)], 0)) / low.total END AS p1
      FROM t CROSS JOIN g CROSS JOIN low CROSS JOIN da CROSS JOIN db
      LEFT JOIN uni ON uni.w = t.w LEFT JOIN one ON one.w = t.w LEFT JOIN ctx ON ctx.v = t.v LEFT JOIN bi ON bi.v = t.v AND bi.w = t.w),
s AS (SELECT r, count(*) AS n_tokens, count(known) AS n_known, any_value(n) AS train_tokens,
             sum(log10((coalesce(known, 0) + 1)::DOUBLE / (n + words + 1))) AS base_score,
             sum(log10(CASE WHEN total IS NULL THEN p1 ELSE coalesce(c2 - db[least(c2, 3)], 0) / total + {_spare("k", "db")} / total * p1 END)) AS score
      FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM d JOIN s USING (r)"""


def _add(path: str, cost: str, edit: str) -> str:
    """A path (nine digits of cost, then its edits) with one more edit; null is no path."""
    return f"lpad(CAST(CAST({path}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {path}[10:] || '{edit}'"


# least() passes over nulls. No cheapest path inserts more than two rows in one place.
_INSERTED = f"""(SELECT conv, i, e, s, u1 AS u, least(a, {_add('u1', '5', 'I')}) AS a FROM
   (SELECT conv, i, e, s, a, least(u, {_add('e', '5', 'I')}, {_add('s', '5', 'I')}, {_add('a', '5', 'I')}) AS u1 FROM dp))"""
_FROM_ROW = {  # states before a row that it may follow unchanged, or with another role
    "e": ([], []), "s": (["e"], []), "u": (["e", "s", "a"], ["e", "s", "a"]), "a": (["u"], ["u"]),
}


def _after_row(state: str) -> str:
    keep, other = _FROM_ROW[state]
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    ways = [_add(f"x.{state}", "2", "D")]
    ways += [f"CASE WHEN NOT gone AND ch = '{state}' THEN {_add(f'x.{p}', more, 'K')} END" for p in keep]
    ways += [f"CASE WHEN NOT gone THEN {_add(f'x.{p}', f'1 + {more}', 'R')} END" for p in other]
    return f"least({', '.join(ways)}, NULL)" if len(ways) == 1 else f"least({', '.join(ways)})"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13 = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hurt FROM conversations),
h AS (SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN hurt = 1 THEN '' WHEN hurt = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN hurt = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE hurt <> 0),
k AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT conv, turn, role, text, copy, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
      FROM h JOIN k ON k.conv_id IS NOT DISTINCT FROM h.conv_id),
b AS (SELECT *, rtrim(text, {_SPACES}) AS bare, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT conv, i, turn, role, text, coalesce(nullif(left(role, 1), ''), ' ') AS ch, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, fault FROM
      (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM b)),
pairs AS (SELECT conv, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM
      (SELECT conv, lag(ch) OVER (PARTITION BY conv ORDER BY i) || ch AS pair FROM f) GROUP BY conv),
facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
      count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
      count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM f GROUP BY conv),
dp AS (SELECT conv, 0::BIGINT AS i, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM facts
       UNION ALL
       SELECT x.conv, f.i, {', '.join(_after_row(q) for q in 'esua')} FROM {_INSERTED} x JOIN f ON f.conv = x.conv AND f.i = x.i + 1),
ends AS (SELECT x.conv, least(x.e, x.a) AS path FROM {_INSERTED} x JOIN facts ON facts.conv = x.conv AND facts.n = x.i),
best AS (SELECT conv, CAST(path[1:9] AS BIGINT) AS cost, path[10:] AS audit FROM ends),
walk AS (SELECT conv, audit, 0::BIGINT AS k, 0::BIGINT AS i, 'e' AS q, []::VARCHAR[] AS made FROM best
         UNION ALL
         SELECT w.conv, w.audit, w.k + 1, CASE WHEN edit = 'I' THEN w.i ELSE w.i + 1 END,
                CASE WHEN edit = 'D' THEN w.q WHEN edit = 'K' THEN f.ch WHEN w.q = 'u' THEN 'a' ELSE 'u' END,
                CASE WHEN edit = 'D' THEN w.made ELSE list_append(w.made, CASE WHEN edit = 'K' THEN f.role WHEN w.q = 'u' THEN 'assistant' ELSE 'user' END
                     || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END) END
         FROM (SELECT *, audit[k + 1] AS edit FROM walk WHERE k < len(audit)) w LEFT JOIN f ON f.conv = w.conv AND f.i = w.i + 1)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM k LEFT JOIN facts ON facts.conv = k.conv LEFT JOIN pairs ON pairs.conv = k.conv LEFT JOIN best ON best.conv = k.conv
LEFT JOIN walk ON walk.conv = k.conv AND walk.k = len(walk.audit)"""
