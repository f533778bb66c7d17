"""DuckDB SQL that gives the rows of the queries in queries.py."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, source, text, {WORDS} AS w,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM d
),
g AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p ON p.rid = w.rid
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM b GROUP BY source),
t AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) AS squares, count(*) AS hosts FROM h),
v AS (SELECT mean, mean * (1 - mean) AS within, squares / n - mean * mean - mean * (1 - mean) * (hosts - 1) / n AS between_hosts FROM t),
s AS (SELECT mean, least(greatest(CASE WHEN between_hosts <= 0 THEN 10000.0 ELSE within / between_hosts - 1 END, 1.0), 10000.0) AS strength FROM v),
j AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source
"""

#: The first level at which the next source in order of cap to weight isn't above its cap.
OP4 = rf"""
WITH d AS (SELECT doc_id, source, text, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (
  SELECT *, 2.0 * source_size AS most,
         CAST([3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM s
),
o AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM n
),
l AS (SELECT min_by(level, most / weight) AS level FROM o WHERE level * weight <= most),
t AS (SELECT source, source_size, CAST(least(most, l.level * weight) AS DOUBLE) AS target FROM n, l),
h AS (SELECT source, size, count(*) AS n, ceil(sqrt(size)) AS g FROM d WHERE size > 0 GROUP BY source, size),
v AS (
  SELECT h.source, size, n, g,
         (target - 2.0 * coalesce(CAST(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0))
         / CAST(sum(n * size * CAST(g AS BIGINT)) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS tried
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source
),
w AS (SELECT source, max_by(tried, size) FILTER (tried * g <= 2.0) AS level FROM v GROUP BY source),
e AS (
  SELECT doc_id, size, d.source, source_size, target, CASE WHEN size > 0 THEN least(2.0, coalesce(w.level * ceil(sqrt(size)), 2.0)) ELSE 0.0 END AS expected,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN w ON d.source IS NOT DISTINCT FROM w.source
),
f AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS fraction, (CAST('0x' || substr(key, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM e),
q AS (
  SELECT *, target - CAST(sum(size * whole) OVER (PARTITION BY source) AS DOUBLE) AS rest,
         CASE WHEN fraction > 0 THEN (u / (1 - u)) / (fraction / (1 - fraction)) END AS odds
  FROM f
),
k AS (
  SELECT *, fraction > 0 AND sum(size) OVER (PARTITION BY source, fraction > 0 ORDER BY odds / (1 + odds), key ROWS UNBOUNDED PRECEDING) - size / 2.0 <= rest AS extra
  FROM q
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT rid, doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)
),
c AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS dropped FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


def op3(rounds: int = 200) -> str:
    """Rules, then the scores as sums over the lengths of paths of links; what is left after so many is nothing."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""(?i)\bhref\s*=\s*[\"'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''\s<>]+)"""
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT row_number() OVER () AS rid, page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS own FROM (SELECT page_id, html, coalesce(rest, '') AS rest FROM p)),
h AS (
  SELECT rid, page_id, {lower.format("own")} AS host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') AS path,
         list_distinct([{lower.format("x")} FOR x IN regexp_extract_all(coalesce(html, ''), '{link}', 1)]) AS linked
  FROM q
),
rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS r(rule, rule_host, rule_path, verdict)),
best AS (
  SELECT rid, rule, verdict FROM (
    SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, verdict DESC) AS k
    FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ) WHERE k = 1
),
seeds AS (
  SELECT DISTINCT 'trust' AS kind, host FROM h JOIN best USING (rid) WHERE verdict = 'allow'
  UNION ALL SELECT DISTINCT 'distrust', host FROM (SELECT host FROM h UNION SELECT unnest(linked) FROM h WHERE host <> '') JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) WHERE rule_path = '/' AND verdict = 'block'
),
edges AS (SELECT src, dst, count(*) AS weight FROM (SELECT host AS src, unnest(linked) AS dst FROM h) WHERE src <> '' AND src <> dst GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT unnest(['distrust', 'reach']), dst, src, weight FROM edges),
steps AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM both_ways),
s0 AS (SELECT kind, host, 0.15::DOUBLE AS score FROM (SELECT * FROM seeds UNION ALL SELECT DISTINCT 'reach', unnest([src, dst]) FROM edges)),
passed AS (
  SELECT 0 AS k, kind, host, score FROM s0
  UNION ALL SELECT p.k + 1, t.kind, t.dst, sum(p.score * t.share * 0.85) FROM passed p JOIN steps t ON t.kind = p.kind AND t.src = p.host WHERE p.k < {rounds} GROUP BY p.k, t.kind, t.dst
),
t AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust,
         coalesce(sum(score) FILTER (kind = 'distrust' AND k > 0), 0) AS came, coalesce(sum(score) FILTER (kind = 'reach' AND k > 0), 0) AS most,
         bool_or(kind = 'distrust' AND k = 0) AS seeded
  FROM passed GROUP BY host
)
SELECT page_id, h.host, path, rule,
       coalesce(verdict, CASE WHEN (seeded OR (most > 0 AND came / most >= 0.1 - 1e-6)) AND distrust > trust + 1e-6 THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best USING (rid) LEFT JOIN t ON t.host = h.host
"""


ORACLE_SQL = {
    "op2_quality_rules": OP2,
    "op3_url_filters": op3(),
    "op4_source_mixing": OP4,
    "op7_line_dedup": OP7,
}
