"""DuckDB SQL that gives the rows of the queries it can express.

Parameters and fixed texts are stated here apart from the operators' code where they
are part of a contract; licence templates are long fixed texts and are shared.
"""

from __future__ import annotations

import re

from .licenses import TEMPLATES

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {WORDS.format(t="text")} AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, text, line, len({WORDS.format(t="line")}) AS n_words,
             trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
often AS (SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT text) AS held FROM n GROUP BY source, norm) f
          JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source WHERE held > 20 OR (held > 5 AND held > 0.10 * docs)),
gone AS (SELECT n.doc_id, sum(n.n_words) AS n FROM n JOIN often o ON o.source IS NOT DISTINCT FROM n.source AND o.norm = n.norm
         GROUP BY n.doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM s"""

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pr JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * pr.n >= 80 * (x.n + y.n - pr.n)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, two.b FROM r JOIN two ON two.a = r.c),
comp AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN comp ON id = doc_id LEFT JOIN size USING (doc_id)"""

_B_WORDS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH iw AS (SELECT item_id, {_B_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, {_B_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dg JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""


def fitting_sql(rounds: int = 12, budget: float = 0.5, temperature: dict | None = None) -> str:
    """Iterative proportional fitting unrolled into one CTE per scaling."""
    temperature = temperature or {"source": 0.5, "lang": 0.7, "topic": 0.7}
    parts = [rf"""d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(text, '') AS text, len({WORDS.format(t="coalesce(text, '')")}) AS n_tokens FROM documents)""",
             r"""t AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE
  WHEN (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) * 50 >= greatest(len(text), 1) THEN 'markup'
  WHEN n_tokens <= (len(text) - len(replace(text, chr(10), '')) + 1) * 8 THEN 'list'
  WHEN n_tokens >= 800 THEN 'long' WHEN n_tokens < 100 THEN 'short' ELSE 'prose' END AS topic FROM d)""",
             "c0 AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM t GROUP BY ALL HAVING sum(n_tokens) > 0)",
             "f0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c0) AS share, tokens / (SELECT sum(tokens) FROM c0) AS fit FROM c0)"]
    for dim, power in temperature.items():
        parts.append(f"m_{dim} AS MATERIALIZED (SELECT {dim} AS v, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target FROM f0 GROUP BY {dim})")
    k = 0
    for _ in range(rounds):
        for dim in temperature:
            parts.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (fit), fit * target / sum(fit) OVER (PARTITION BY {dim}) AS fit "
                         f"FROM f{k} f JOIN m_{dim} ON v IS NOT DISTINCT FROM {dim})")
            k += 1
    return "WITH " + ",\n".join(parts) + rf""",
r AS (SELECT t.*, coalesce(fit / share, 1.0) AS ratio FROM t LEFT JOIN f{k} f ON f.source IS NOT DISTINCT FROM t.source
      AND f.lang IS NOT DISTINCT FROM t.lang AND f.topic = t.topic)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(ratio, 6) AS ratio,
       round(least(ratio * {budget}, 1.0), 6) AS probability, round(greatest(ratio * {budget}, 1.0), 6) AS weight,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < least(ratio * {budget}, 1.0) AS kept
FROM r"""


def license_sql(threshold: float = 0.8) -> str:
    rows = []
    for i, ((name, _), text) in enumerate(sorted(TEMPLATES.items())):
        w = [x for x in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if x]
        rows += [f"({i}, '{name}', '{a} {b}')" for a, b in sorted(set(zip(w, w[1:], strict=False)))]
    return rf"""
WITH t(k, license, g) AS (VALUES {", ".join(rows)}),
m AS (SELECT k, license, count(*) AS m FROM t GROUP BY ALL),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, 'line ' || i AS unit, string_split(text, chr(10))[i] AS s FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)
      UNION ALL SELECT doc_id, 'block ' || i, b[i] FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM
        (SELECT *, regexp_split_to_array(text, '\n[\x20\t]*\n') AS b FROM d) WHERE len(b) > 1)
      UNION ALL SELECT doc_id, 'text', text FROM d WHERE contains(text, chr(10))),
w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM u),
g AS (SELECT DISTINCT doc_id, unit, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM w)),
n AS (SELECT doc_id, unit, count(*) AS n FROM g GROUP BY ALL),
x AS (SELECT doc_id, unit, k, count(*) AS common FROM g JOIN t USING (g) GROUP BY ALL),
y AS (SELECT doc_id, unit, license, 2 * common / (n + m) AS dice FROM x JOIN n USING (doc_id, unit) JOIN m USING (k)),
b AS (SELECT doc_id, unit, arg_min(license, (-dice, license)) AS license, max(dice) AS dice FROM y WHERE dice >= {threshold} GROUP BY doc_id, unit),
z AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(*) AS n_units,
             array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM b GROUP BY doc_id)
SELECT doc_id, license, round(dice, 9) AS dice, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN z USING (doc_id)"""


def _vectors_sql(scale: int, columns: str) -> str:
    return rf"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, {columns}, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64)"""


# the floor of s / n for a positive n
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _squared(a: str, b: str, dims: int) -> str:
    return f"CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))) AS BIGINT)"


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """k-means unrolled into one assignment and one mean per round."""
    parts = [_vectors_sql(256, "vec_id"),
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))"]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, {_squared('v.x', 'c.x', 64)} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list({_FLOOR} ORDER BY i) AS x FROM
  (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.k"""


def codes_sql(rounds: int = 4) -> str:
    """Codebooks of four parts, one assignment and one mean per round."""
    parts = [_vectors_sql(1024, "vec_id, label"),
             "p AS MATERIALIZED (SELECT r, p, x[16 * p + 1:16 * p + 16] AS x FROM v, range(4) t(p))",
             """b0 AS MATERIALIZED (SELECT p, e, p.x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM
  (SELECT r, vec_id, x FROM v ORDER BY vec_id NULLS LAST, x LIMIT 256)) USING (r))"""]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, {_squared('p.x', 'b.x', 16)} AS d FROM p JOIN b{i} b USING (p)) GROUP BY r, p)")
        if i < rounds:
            parts.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT p, e, list({_FLOOR} ORDER BY i) AS x FROM
  (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN p USING (r, p), range(1, 17) t(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return "WITH " + ",\n".join(parts) + f""",
o AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o JOIN v USING (r), h"""


ORACLE: dict[str, str] = {
    "op1_line_frequency": OP1,
    "op4_lsh_forest": OP4,
    "op6_proportional_fitting": fitting_sql(),
    "op7_license_dice": license_sql(),
    "op10_winnowing": OP10,
    "op12_walsh_kmeans": clusters_sql(),
    "op13_value_dictionaries": codes_sql(),
}
