"""DuckDB SQL fragments for the oracle side. These restate the semantics in
SQL independently of the Spark expressions (different engine, different
regex library), so agreement is evidence of correctness."""

from __future__ import annotations

# Fixed values, stated apart from the library's: whitespace as Python sees it, and the
# decimals that results are rounded to.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ROUND = 6


def r(x: str, d: int = ROUND) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


def collapse_ws(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def clean_strict(c: str) -> str:
    t = collapse_ws(c)
    t = f"regexp_replace({t}, '[^a-zA-Z0-9 .,!?-]', '', 'g')"
    t = f"regexp_replace({t}, ' +([.,!?])', '\\1', 'g')"
    t = f"regexp_replace({t}, '([.,!?]){{2,}}', '\\1', 'g')"
    return (f"array_to_string(list_transform(string_split({t}, '. '), "
            f"lambda s: upper(substring(s, 1, 1)) || lower(substring(s, 2))), '. ')")


def clean_permissive(c: str) -> str:
    drop = "[^\\p{L}\\p{N}_" + WS[1:-1] + ".,!?''\"-]"
    t = f"regexp_replace({c}, '{drop}', ' ', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ([.,!?])', '\\1', 'g')"
    t = f"regexp_replace({t}, '\\.{{2,}}', '...', 'g')"
    return f"trim({t})"


def words(c: str) -> str:
    return f"list_filter(string_split({collapse_ws(c)}, ' '), lambda w: w <> '')"


def word_count(c: str) -> str:
    return f"CAST(coalesce(len({words(c)}), 0) AS BIGINT)"


def dup_key(c: str) -> str:
    return collapse_ws(f"lower({c})")


def sentiment(quality: str, toxic: str) -> str:
    return (f"CASE WHEN {toxic} = 1 THEN 'negative' WHEN {quality} = 0 THEN 'neutral' "
            f"ELSE 'positive' END")


REVIEWS = f"""reviews AS (
  SELECT d.doc_id AS id, d.doc_id AS pos, d.text, d.source AS domain,
         CASE WHEN l.doc_id IS NULL THEN NULL ELSE {sentiment('l.quality', 'l.toxic')} END AS sentiment
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

WHOLE = f"""{REVIEWS},
whole AS (SELECT * REPLACE (coalesce(sentiment, 'unlabelled') AS sentiment) FROM reviews)"""

LABELLED = f"""labelled AS (
  SELECT d.doc_id AS id, d.doc_id AS pos, d.text, d.source AS domain,
         {sentiment('l.quality', 'l.toxic')} AS sentiment
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

PREPARED = f"""prep0 AS (SELECT *, {clean_strict('text')} AS clean_text FROM reviews),
prepared AS (
  SELECT *, {word_count('clean_text')} AS word_count,
         coalesce({word_count('clean_text')} BETWEEN 5 AND 150, false) AS keep_len,
         {dup_key('clean_text')} AS dup_key
  FROM prep0)"""


def vectors(src: str, scope: str = "") -> str:
    """CTEs toks(vid, tok, tf), norms(vid, n2), sims(va, vb, sim) over the
    length-kept rows of ``src`` (brute force over every token-sharing pair)."""
    sc = f"{scope}, " if scope else ""
    return f"""vrows AS (
  SELECT *, list_sort({words('dup_key')}) AS canon FROM {src} WHERE keep_len),
vrows2 AS (SELECT *, md5(array_to_string(canon, ' ')) AS vid FROM vrows),
vdist AS (SELECT vid, any_value(canon) AS canon FROM vrows2 GROUP BY vid),
toks AS (SELECT vid, tok, count(*) AS tf FROM (SELECT vid, unnest(canon) AS tok FROM vdist) GROUP BY vid, tok),
norms AS (SELECT vid, sum(tf * tf) AS n2 FROM toks GROUP BY vid),
dots AS (
  SELECT a.vid AS va, b.vid AS vb, sum(a.tf * b.tf) AS dot
  FROM toks a JOIN toks b ON a.tok = b.tok GROUP BY a.vid, b.vid),
sims AS (
  SELECT va, vb, round(CAST(dot AS DOUBLE) / sqrt(CAST(na.n2 * nb.n2 AS DOUBLE)), 9) AS sim
  FROM dots JOIN norms na ON na.vid = va JOIN norms nb ON nb.vid = vb),
vnodes AS (SELECT {sc}vid, min(pos) AS first_pos FROM vrows2 GROUP BY {sc}vid)"""


def shuffle_key(idc: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({idc} AS VARCHAR))"


def stratified(src: str, label: str = "sentiment", idc: str = "id", validation: bool = True) -> str:
    """CTEs ending in ``split_rows`` (all columns of src + split): test quota
    ceil(0.15 n) = (15n+99)//100, validation ceil(0.15/0.85 m) = (3m+16)//17,
    largest remainders with ties by label, seeded md5 order within a class."""
    v = ("(3 * m + 16) // 17" if validation else "0")
    return f"""cnt AS (SELECT {label}, count(*) AS n_c FROM {src} GROUP BY {label}),
elig AS (SELECT * FROM cnt WHERE n_c >= 2),
tq AS (SELECT *, (15 * sum(n_c) OVER () + 99) // 100 AS t, sum(n_c) OVER () AS n FROM elig),
tf AS (SELECT *, (t * n_c) // n AS f, (t * n_c) % n AS rem FROM tq),
tl AS (SELECT *, t - sum(f) OVER () AS l, row_number() OVER (ORDER BY rem DESC, {label}) AS rk FROM tf),
tc AS (SELECT {label}, n_c, f + CASE WHEN rk <= l THEN 1 ELSE 0 END AS t_c FROM tl),
vm AS (SELECT *, n_c - t_c AS m_c, sum(n_c - t_c) OVER () AS m FROM tc),
vq AS (SELECT *, {v} AS v FROM vm),
vf AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE (v * m_c) // m END AS f2,
              CASE WHEN m = 0 THEN 0 ELSE (v * m_c) % m END AS rem2 FROM vq),
vl AS (SELECT *, v - sum(f2) OVER () AS l2, row_number() OVER (ORDER BY rem2 DESC, {label}) AS rk2 FROM vf),
quota AS (SELECT {label}, t_c, f2 + CASE WHEN rk2 <= l2 THEN 1 ELSE 0 END AS v_c FROM vl),
sranked AS (SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY {shuffle_key(idc)}, {idc}) AS srk FROM {src} s),
split_rows AS (
  SELECT r.* EXCLUDE (srk), CASE WHEN srk <= coalesce(q.t_c, 0) THEN 'test'
       WHEN srk <= coalesce(q.t_c, 0) + coalesce(q.v_c, 0) THEN 'validation' ELSE 'train' END AS split
  FROM sranked r LEFT JOIN quota q ON q.{label} = r.{label})"""


VERDICTS = f"""{REVIEWS},
{PREPARED},
{vectors('prepared')},
flags AS (SELECT j.*,
  EXISTS (SELECT 1 FROM vrows2 k WHERE k.dup_key = j.dup_key AND k.pos < j.pos) AS is_exact,
  EXISTS (SELECT 1 FROM vrows2 k JOIN sims s ON s.va = k.vid WHERE s.vb = j.vid AND k.pos < j.pos AND s.sim >= 0.92) AS is_near
  FROM vrows2 j),
verdict_all AS (
  SELECT p.*, CASE WHEN f.is_exact THEN 'exact' WHEN f.is_near THEN 'similar' END AS dup_type
  FROM prepared p LEFT JOIN flags f ON f.pos = p.pos),
curated AS (SELECT * FROM verdict_all WHERE keep_len AND dup_type IS NULL)"""


def summary(src: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total_processed,
  CAST(count(*) FILTER (WHERE NOT keep_len) AS BIGINT) AS length_filtered,
  CAST(count(*) FILTER (WHERE dup_type IS NOT NULL) AS BIGINT) AS duplicates_removed,
  CAST(count(*) FILTER (WHERE dup_type = 'exact') AS BIGINT) AS exact_duplicates,
  CAST(count(*) FILTER (WHERE dup_type = 'similar') AS BIGINT) AS near_duplicates,
  CAST(count(*) FILTER (WHERE NOT keep_len OR dup_type IS NOT NULL) AS BIGINT) AS total_removed,
  CAST(count(*) FILTER (WHERE keep_len AND dup_type IS NULL) AS BIGINT) AS total_accepted
FROM {src}"""


def research_domain(c: str) -> str:
    return (f"['healthcare', 'finance', 'technology', 'retail']"
            f"[(CAST(regexp_extract({c}, '(\\d+)$', 1) AS BIGINT) % 4) + 1]")


LABEL_IDX = "CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END"

MIX = """mix(domain, label_idx, expected) AS (VALUES
  ('healthcare', 0, CAST(0.15 AS DOUBLE)), ('healthcare', 1, CAST(0.25 AS DOUBLE)), ('healthcare', 2, CAST(0.60 AS DOUBLE)),
  ('finance', 0, CAST(0.30 AS DOUBLE)), ('finance', 1, CAST(0.40 AS DOUBLE)), ('finance', 2, CAST(0.30 AS DOUBLE)),
  ('technology', 0, CAST(0.10 AS DOUBLE)), ('technology', 1, CAST(0.35 AS DOUBLE)), ('technology', 2, CAST(0.55 AS DOUBLE)))"""
