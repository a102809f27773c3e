"""DuckDB SQL for the rows of queries whose operators count or compare strings."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
# the checksum of the id's digits, bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"


def _discounts(counts: str) -> str:
    """A struct of the three discounts and what they leave, from a table with a count column."""
    return f"""(SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN [least(greatest(1 - 2 * y * n2 / n1, 0), 1), least(greatest(2 - 3 * y * n3 / n2, 0), 2), least(greatest(CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5 END, 0), 3)]
      ELSE [0.5, 1.0, 1.5] END FROM (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM {counts})))"""


def _context(counts: str, keys: str, d: str) -> str:
    """The total of every context and the share that the discounts leave."""
    return f"SELECT {keys}, sum(c)::DOUBLE AS total, ({d}[1] * count(*) FILTER (c = 1) + {d}[2] * count(*) FILTER (c = 2) + {d}[3] * count(*) FILTER (c > 2)) / sum(c) AS rest FROM {counts}, d GROUP BY {keys}, d.d1, d.d2, d.d3"


#: Trigram counts, counts of distinct words before pairs and words, discounts, and the interpolated product over every text.
LANGUAGE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(({_CRC}) % 10 = 0, true) AS held_out, list_append({_WORDS}, ' ') AS t FROM documents),
tok AS (SELECT r, doc_id, held_out, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM docs),
g AS (SELECT *, lag(w, 1, '  ') OVER o AS v, lag(w, 2, '  ') OVER o AS u FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
uni AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*) AS v FROM uni),
tri AS (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY ALL),
two AS (SELECT v, w, count(*) AS c FROM tri GROUP BY ALL),
one AS (SELECT w, count(*) AS c FROM two GROUP BY ALL),
d AS (SELECT {_discounts('one')} AS d1, {_discounts('two')} AS d2, {_discounts('tri')} AS d3),
low AS (SELECT sum(c)::DOUBLE AS pairs, sum(CASE WHEN c = 1 THEN d1[1] WHEN c = 2 THEN d1[2] ELSE d1[3] END) / sum(c) AS rest FROM one, d),
c2 AS ({_context('two', 'v', 'd2')}),
c3 AS ({_context('tri', 'u, v', 'd3')}),
p AS (SELECT g.r, uni.c AS known,
       coalesce(greatest(one.c - d1[least(one.c, 3)], 0) / low.pairs, 0) + coalesce(low.rest, 1) / (n.v + 1) AS p1, coalesce(greatest(two.c - d2[least(two.c, 3)], 0) / c2.total, 0) AS q2, coalesce(c2.rest, 1) AS r2,
       coalesce(greatest(tri.c - d3[least(tri.c, 3)], 0) / c3.total, 0) AS q3, coalesce(c3.rest, 1) AS r3
      FROM g CROSS JOIN d CROSS JOIN low CROSS JOIN n LEFT JOIN uni USING (w) LEFT JOIN one USING (w) LEFT JOIN two ON two.v = g.v AND two.w = g.w LEFT JOIN c2 ON c2.v = g.v
      LEFT JOIN tri ON tri.u = g.u AND tri.v = g.v AND tri.w = g.w LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens,
       round(sum(log10((coalesce(known, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))), 6) AS base_score, round(sum(log10(q3 + r3 * (q2 + r2 * p1))), 6) AS score
FROM p JOIN docs USING (r) CROSS JOIN n GROUP BY r, doc_id, held_out
"""

#: All 50-byte substrings by the smallest document that holds them; the bytes that later ones cover go.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, length(h) // 2 AS n, unnest(range(0, greatest(length(h) // 2 - 49, 0), 500)) AS pos, h FROM d),
cuts AS (SELECT doc_id, pos, n, substr(h, 2 * pos + 1, 1098) AS s FROM parts),
grams AS (SELECT doc_id, pos + k AS p, substr(s, 2 * k + 1, 100) AS x FROM (SELECT *, unnest(range(0, least(500, n - 49 - pos))) AS k FROM cuts)),
first AS (SELECT x, min(doc_id) AS f FROM grams GROUP BY x HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM grams JOIN first USING (x) WHERE f < doc_id),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
ends AS (SELECT doc_id, 0 AS s, min(a) AS e FROM spans GROUP BY doc_id UNION ALL SELECT doc_id, b, lead(a, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY a) FROM spans),
kept AS (SELECT doc_id, coalesce(string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s), '') AS h FROM ends JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def quality_sql(threshold: float, prior: float, buckets: int, run: int) -> str:
    """The base figures, and the mean log ratio over the checksum buckets of words and pairs."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
tok AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * k - 1, 2))::BIGINT for k in range(1, length(h) // 2 + 1)]), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) AS c
        FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM tok)),
t AS (SELECT r, i, c, lead(c, 1, -1) OVER (PARTITION BY r ORDER BY i) AS d FROM tok JOIN crc USING (w)),
f AS (SELECT r, c % {buckets} AS b FROM t UNION ALL SELECT r, (c * 40503 + d) % {buckets} FROM t),
good AS (SELECT DISTINCT r FROM docs JOIN labels USING (doc_id) WHERE quality = 1 AND coalesce(toxic, 0) = 0),
n AS (SELECT b, count(*) AS raw, count(good.r) AS target FROM f LEFT JOIN good USING (r) GROUP BY b),
ratio AS (SELECT b, ln((target + {prior}) / (raw * (SELECT sum(target)::DOUBLE / sum(raw) FROM n) + {prior})) AS x FROM n),
score AS (SELECT r, avg(x) AS llr FROM f JOIN ratio USING (b) GROUP BY r),
windows AS (SELECT r, unnest([array_to_string(w[i:i + {run - 1}], ' ') for i in range(1, len(w) - {run - 2})]) AS x, unnest(range(1, len(w) - {run - 2})) AS i FROM docs WHERE len(w) >= {run}),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {run})) AS p FROM again) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
out AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
        coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0) AS llr FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN score USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND llr >= {threshold} AS kept, round(llr, 6) AS llr FROM out
"""
