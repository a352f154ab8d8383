"""SQL (DuckDB) giving the rows of this package's queries, where SQL can express them.

Fitted models (URL, DOM, toxicity), XXH64 fingerprints, winnowed hashes and BPE ids are beyond it; tests hold those queries
against brute force.
"""

from __future__ import annotations

from touchline.llm import secret_markov as s
from touchline.llm.poisson_mixing import SEED
from touchline.llm.queries import TARGET_WEIGHTS

_WEIGHTS = " ".join(f"WHEN source = '{name}' THEN {weight}" for name, weight in TARGET_WEIGHTS.items())

POISSON_MIXING = f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size, CASE {_WEIGHTS} ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN weight / sum(weight) OVER () * sum(size) OVER () / size ELSE 1.0 END AS rate FROM sizes),
terms AS (
  SELECT source, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM rates, range(0, 400) AS t(j) WHERE rate > 0),
upto AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms),
draws AS (
  SELECT *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~') || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(u2.j) AS n
  FROM draws d LEFT JOIN upto u2 ON d.source IS NOT DISTINCT FROM u2.source AND u2.c <= d.u
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS "copy" FROM counted WHERE n > 0
"""

LINE_WINDOWS = """
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM cut),
full_lines AS (SELECT doc_id, i, rtrim(line, ' ') AS line FROM each WHERE trim(line, ' ') <> ''),
windows AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, [line, lead(line, 1) OVER w, lead(line, 2) OVER w] AS held
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
whole AS (SELECT * FROM windows WHERE b IS NOT NULL),
ranked AS (
  SELECT *, first_value(doc_id) OVER o AS d0, first_value(a) OVER o AS a0, first_value(b) OVER o AS b0
  FROM whole WINDOW o AS (PARTITION BY held ORDER BY doc_id, a)),
later AS (
  SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(a, b0 + 1) ELSE a END AS a, b FROM ranked WHERE doc_id <> d0 OR a <> a0),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later WHERE a <= b),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
  GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars,
       coalesce(l.n, 0)::INT AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: pieces between matches and matches in turn, their lengths added up."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS k, start AS s, start + length(m) AS e, m AS v FROM (
    SELECT doc_id, m, g, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (
             PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, unnest(range(0, len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[:len(ms)]) AS gap
          FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS ms, regexp_extract_all(text, '{quoted}', {group}) AS gs,
                       string_split_regex(text, '{quoted}') AS gaps FROM texts)) p
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) q
  WHERE length(g) >= {least}"""


_KIND = "[" + ", ".join(f"'{k}'" for k in s.KINDS) + "][k + 1]"

SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_found(k, p, g, n) for k, (p, g, n, _) in enumerate(s.PATTERNS))}),
candidates AS (
  SELECT *, EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e) AS random
  FROM ({_found(3, s.CANDIDATE, 0, 1)}) c),
pairs AS (
  SELECT doc_id, s, random, substr(v, i::INT, 1) AS x, substr(v, i::INT + 1, 1) AS y
  FROM (SELECT *, unnest(range(1, length(v))) AS i FROM candidates)),
counts AS (SELECT x, y, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM pairs GROUP BY x, y),
seen AS (
  SELECT *, sum(r) OVER a AS rn, sum(o) OVER a AS o_n, greatest(count(*) FILTER (r > 0) OVER a, 1) AS rk,
         greatest(count(*) FILTER (o > 0) OVER a, 1) AS ok, sum(r) OVER b AS ry, sum(o) OVER b AS oy, sum(r) OVER () AS rt, sum(o) OVER () AS ot
  FROM counts WINDOW a AS (PARTITION BY x), b AS (PARTITION BY y)),
ratios AS (
  SELECT x, y, ln(((r + rk * (ry + {s.PSEUDO}) / (rt + {s.PSEUDO * s.ALPHABET})) / (rn + rk))
                  / ((greatest(o - 1, 0) + ok * (oy + {s.PSEUDO}) / (ot + {s.PSEUDO * s.ALPHABET})) / (greatest(o_n - 1, 0) + ok))) AS ratio FROM seen),
prior AS (SELECT ln((count(*) FILTER (random) + 1) / (count(*) FILTER (NOT random) + 1)) AS p FROM candidates),
scored AS (SELECT doc_id, s, sum(ratio) AS t FROM pairs JOIN ratios USING (x, y) WHERE NOT random GROUP BY doc_id, s),
spans AS (
  SELECT doc_id, k, s, e FROM base
  UNION ALL SELECT c.doc_id, c.k, c.s, c.e FROM candidates c JOIN scored USING (doc_id, s) WHERE t + (SELECT p FROM prior) > 0),
listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_poisson_mixing": POISSON_MIXING,
    "op3_line_windows": LINE_WINDOWS,
    "op8_secret_markov": SECRETS,
}

#: crc32 of a decimal number, bit by bit: at every eighth step the next character's code is mixed in.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(doc_id::VARCHAR))), lambda c, x:
  CASE WHEN (xor(c, CASE WHEN x % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (x // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) & 1) = 1
       THEN xor(xor(c, CASE WHEN x % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (x // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) >> 1, 3988292384)
       ELSE xor(c, CASE WHEN x % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (x // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) >> 1 END), 4294967295)"""

PERIODIC_RUNS = rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_CRC} AS h FROM documents),
sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM cut),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM sized),
steps AS (SELECT *, 1 + (n - a) // (3 + coalesce(g, 0) % 8) AS p FROM placed),
words AS (SELECT doc_id, n, i, ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::INT] AS w
          FROM (SELECT *, unnest(range(0, n)) AS i FROM steps)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretches x WHERE NOT EXISTS (
  SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT doc_id, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i
  GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", l AS length, q AS period, 1000 * l // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
ORACLES["op12_periodic_runs"] = PERIODIC_RUNS

HARD_NEGATIVES = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS "rank", n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""
ORACLES["op13_anchor_trees"] = HARD_NEGATIVES

WARC = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM bodies),
latest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM latest
"""
ORACLES["op11_warc"] = WARC
