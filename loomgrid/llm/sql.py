"""DuckDB SQL for the results of those training-data queries that SQL can express."""

from __future__ import annotations

from .common import ASCII_LOWER, ASCII_UPPER
from .licenses import PHRASES, TEMPLATES, K, template_rows
from .mixture import STEPS
from .urls import LISTED, RULES, rule_text

#: Words of letters and digits, and words between blanks.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def words_sql(table: str, key: str, pattern: str) -> str:
    low = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"
    return f"SELECT {key}, regexp_extract_all({low}, '{pattern}') AS w FROM {table}"


def decontamination(window: int = 13) -> str:
    """op7: windows of all items, matched at each place of each document."""
    n = window
    return f"""
WITH dw AS ({words_sql("documents", "doc_id", WORD)}), bw AS ({words_sql("benchmark", "item_id::VARCHAR AS item", WORD)}),
bi AS (SELECT item, w, CASE WHEN len(w) < {n} THEN len(w) ELSE {n} END AS k, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT k FROM win),
pl AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, sizes WHERE len(w) >= k),
m AS (SELECT a.doc_id, a.i, a.k, win.item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM pl) a JOIN win ON win.k = a.k AND win.s = a.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) x GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def near_duplicates() -> str:
    """op9: all pairs of sets that share a shingle, counted; components by the least reachable id."""
    return f"""
WITH RECURSIVE dw AS ({words_sql("documents", "doc_id", BLANK_WORD)}),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' '), len(w) < 5) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM dw WHERE len(w) > 0) a),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT r.node AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(seen) AS component_id, min(seen) = r.node AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node, n.n"""


def suffix_dedup(window: int = 100) -> str:
    """op5: every string of 100 bytes, as hexadecimal digits, with the place where it starts first."""
    n = window
    return f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, {2 * n})) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {n - 1})) AS p FROM h WHERE length(x) >= {2 * n}) a),
firsts AS (SELECT s, min({{'d': doc_id, 'p': p}}) AS f FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM win JOIN firsts USING (s) WHERE NOT (f.d = doc_id AND f.p = p)),
runs AS (SELECT doc_id, p, sum(CASE WHEN prev IS NULL OR p > prev + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM gone) a),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS z FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b, a AS e, z - a AS n FROM spans),
lasts AS (SELECT doc_id, max(z) AS z FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS k, sum(n) AS n_removed, count(*) AS n_spans FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN z IS NULL THEN x ELSE k || substr(x, 2 * z + 1) END)) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN lasts USING (doc_id)"""


def license_scan(min_share: float = 0.7, max_shift: int = 3) -> str:
    """op8: rolling k-grams of words against all positions of all templates."""
    rows = template_rows(PHRASES, TEMPLATES)
    grams = ", ".join(f"({n}, '{label}', {base}, {need}, {i}, '{' '.join(w[i : i + K])}')" for n, label, base, need, w in rows for i in range(need))
    return f"""
WITH t(tmpl, label, base, need, tpos, g) AS (VALUES {grams}), dw AS ({words_sql("documents", "doc_id", WORD)}),
v AS (SELECT doc_id, tmpl, label, base, need, tpos, i AS i, i - tpos AS diag FROM (SELECT doc_id, i, array_to_string(w[i + 1:i + {K}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - {K - 1})) AS i FROM dw WHERE len(w) >= {K}) a) b JOIN t USING (g)),
f AS (SELECT *, CASE WHEN diag = lag(diag) OVER w THEN 0 WHEN base THEN 1 WHEN diag - lag(diag) OVER w <= {max_shift} AND i - lag(i) OVER w <= {K + max_shift} THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, tmpl ORDER BY diag, i)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tmpl ORDER BY diag, i ROWS UNBOUNDED PRECEDING) AS span FROM f),
c AS (SELECT doc_id, tmpl, label, base, count(DISTINCT tpos)::DOUBLE / need AS share, min(diag) AS diag FROM s GROUP BY doc_id, tmpl, label, base, need, span),
d AS (SELECT doc_id, count(*) FILTER (base AND share = 1) AS n_base, min(diag) FILTER (base AND share = 1) AS first_word, max(diag) FILTER (base AND share = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share = 1) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND share = 1) OR (NOT base AND share >= {min_share}::DOUBLE)) AS labels,
  max(CASE WHEN NOT base OR share = 1 THEN share END) AS score FROM c GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM dw LEFT JOIN d USING (doc_id)"""


def url_filter() -> str:
    """op4: rules by length, then the list."""
    fits = {r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))" for r in RULES}
    order = sorted(RULES, key=lambda x: (len(rule_text(x)), len(x[1]), x[0] == "block"), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{rule_text(r)}'" for r in order) + " END"
    kind = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[0]}'" for r in order) + " END"
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED)
    return f"""
WITH a AS (SELECT page_id, coalesce(instr(url, '://') > 0, false) AS known, substr(url, instr(url, '://') + 3) AS rest FROM pages),
b AS (SELECT page_id, known, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, CASE WHEN known THEN translate(raw, '{ASCII_UPPER}', '{ASCII_LOWER}') ELSE '' END AS host,
  CASE WHEN known THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path FROM b),
d AS (SELECT page_id, host, path, {rule} AS rule, {kind} AS rule_verdict, ({listed}) AS listed FROM c)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM d"""


def source_mix(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 4096) -> str:
    """op11: words that each document gives, block by block; shards don't change them."""
    b, n = block, len(weights)

    def place(k: str, turn: str) -> str:
        rotated = ["CASE " + " ".join(f"WHEN {p} % blocks <> 0 THEN {p}" for p in (*STEPS[i:], *STEPS[:i])) + " END" for i in range(len(STEPS))]
        step = f"CASE {turn} % {len(STEPS)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(rotated)) + " END"
        return f"CASE WHEN blocks = 1 THEN 0 ELSE (({step})::BIGINT % blocks * ({k}) + no * 7919 + ({turn}) * 104729) % blocks END"

    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
w AS (SELECT *, ({list(weights)})[(no % {n} + 1)::INT]::DOUBLE AS weight, source_size * {most}::DOUBLE AS top FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY top / weight, no) AS rank FROM w),
u AS (SELECT *, ((SELECT sum(source_size) FROM s) * {share}::DOUBLE - coalesce(sum(top) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM r),
t AS (SELECT source, source_size, no, coalesce(least(top, (SELECT arg_min(unit, rank) FROM u WHERE unit * weight <= top) * weight), top) AS target FROM u),
q AS (SELECT *, (source_size + {b - 1}) // {b} AS blocks, floor(target)::BIGINT // source_size AS passes, floor(target)::BIGINT % source_size AS rest FROM t WHERE source_size > 0),
q1 AS (SELECT *, blocks * {b} - source_size AS lack, {place("blocks - 1", "passes")} AS short_at FROM q),
q2 AS (SELECT *, CASE WHEN short_at < (rest + {b - 1}) // {b} THEN (rest + lack + {b - 1}) // {b} ELSE (rest + {b - 1}) // {b} END AS part FROM q1),
q3 AS (SELECT *, CASE WHEN part > 0 THEN part * {b} - CASE WHEN short_at < part THEN lack ELSE 0 END - rest ELSE 0 END AS cut, passes * blocks + part AS draws FROM q2),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) - size AS start FROM d),
e AS (SELECT p.doc_id, start, size, q3.*, unnest(range(start::BIGINT // {b}, (start + size - 1)::BIGINT // {b} + 1)) AS k FROM p JOIN q3 ON p.source IS NOT DISTINCT FROM q3.source WHERE size > 0),
f AS (SELECT *, unnest(range(0, {most})) AS pass FROM e),
g AS (SELECT *, pass * blocks + {place("k", "pass")} AS draw FROM f),
x AS (SELECT doc_id, greatest(0, least(start + size, least((k + 1) * {b}, source_size) - CASE WHEN draw = draws - 1 THEN cut ELSE 0 END) - greatest(start, k * {b})) AS words FROM g WHERE draw < draws),
y AS (SELECT doc_id, sum(words)::BIGINT AS taken FROM x GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(y.taken, 0)::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN y ON y.doc_id = d.doc_id"""


def periodic_runs(least: int = 24, times: int = 3) -> str:
    """op13: periods that three words on their own grid allow, and the stretches where each holds."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda v, b: list_reduce([xor(v, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: CASE WHEN u % 2 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END)), 4294967295)"
    return f"""
WITH d AS (SELECT doc_id, {crc} AS h, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w FROM documents),
n AS (SELECT doc_id, h, h // 10 AS g, len(w) AS n, w FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM n),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
wt AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM p) x),
q AS (SELECT doc_id, n, unnest(range(1, n // {times} + 1)) AS q FROM n WHERE n >= {least}),
g AS (SELECT doc_id, q, unnest(range(0, n - 2 * q, q)) AS i FROM q),
g1 AS MATERIALIZED (SELECT g.doc_id, q, g.i, word FROM g JOIN wt ON wt.doc_id = g.doc_id AND wt.i = g.i),
g2 AS MATERIALIZED (SELECT g1.doc_id, q, g1.i, g1.word FROM g1 JOIN wt ON wt.doc_id = g1.doc_id AND wt.i = g1.i + q WHERE wt.word = g1.word),
c AS MATERIALIZED (SELECT DISTINCT g2.doc_id, q FROM g2 JOIN wt ON wt.doc_id = g2.doc_id AND wt.i = g2.i + 2 * q WHERE wt.word = g2.word),
e1 AS MATERIALIZED (SELECT c.doc_id, q, i, word FROM c JOIN wt USING (doc_id)),
e AS (SELECT e1.doc_id, q, e1.i FROM e1 JOIN wt ON wt.doc_id = e1.doc_id AND wt.i = e1.i + q WHERE wt.word = e1.word),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS r FROM e) x GROUP BY doc_id, q, r HAVING count(*) + q >= greatest({least}, {times} * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT wt.doc_id, string_agg(word, ' ' ORDER BY wt.i) AS kept FROM wt LEFT JOIN gone ON gone.doc_id = wt.doc_id AND gone.i = wt.i WHERE gone.i IS NULL GROUP BY wt.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
