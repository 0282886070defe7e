"""DuckDB SQL for the registered queries that plain SQL can express."""

from __future__ import annotations

from ledgerline.llm import license_texts as L

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str, separators: str, fold: bool = True) -> str:
    t = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')" if fold else f"coalesce({text}, '')"
    return f"list_filter(regexp_split_to_array({t}, '{separators}'), lambda x: x <> '')"


_SPACE = r"[\x20\x09-\x0D]+"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words('text', _SPACE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
         JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id"""

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
WITH d AS (SELECT doc_id, {_words('text', _NOT_WORD)} AS w FROM documents),
i AS (SELECT item_id, {_words('text', _NOT_WORD)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS size,
          unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda p: array_to_string(w[p:p + 12], ' '))) AS win
        FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT doc_id, p, spot.size, item_id FROM spot JOIN win ON win.size = spot.size AND win.win = array_to_string(w[p:p + spot.size - 1], ' ')),
places AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_words('text', _SPACE, fold=False)}) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 13) AS BIGINT)
    + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
h AS (SELECT *, 1 / sqrt(CAST(greatest(size, 1) AS DOUBLE)) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(round(size * h * 1024) AS BIGINT)) AS DOUBLE) AS units,
  CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM h GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM s),
l AS (SELECT o.*, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
-- the level after the sources before are full; the first source that is not full has the final one
f AS (SELECT coalesce(min_by(level, k) FILTER (WHERE 2 * source_size > level * weight), 1e300) AS level FROM l),
t AS (SELECT source, source_size, units, least(CAST(2 * source_size AS DOUBLE), f.level * weight) AS target FROM o, f),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM t),
r AS (SELECT *, target - certain * source_size AS rest FROM c),
p AS (SELECT h.*, source_size, target, certain, rest,
  least(greatest(CASE WHEN units > 0 THEN rest * 1024 / units ELSE 0 END * h, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p),
x AS (SELECT *, least(CAST(floor(q / (1 + q) * 67108864) AS BIGINT), 67108863) AS cell FROM q),
cells AS (SELECT source, rest, cell, sum(size) AS words FROM x WHERE rest > 0 GROUP BY source, rest, cell),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell) AS upto FROM cells),
cut AS (SELECT source, min(CASE WHEN 2 * (rest - (upto - words)) >= words THEN cell ELSE cell - 1 END) AS last
  FROM run WHERE upto - words < rest AND upto >= rest GROUP BY source)
SELECT doc_id, size, source_size, target,
  CAST((certain + CASE WHEN cell <= coalesce(last, -1) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(certain + CASE WHEN cell <= coalesce(last, -1) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM x LEFT JOIN cut ON x.source IS NOT DISTINCT FROM cut.source"""


def _canonical(x: str) -> str:
    line = (r"(?m)^[^\p{L}\p{N}\n©]*(copyright[\s\v]*(\(c\)|©|[0-9])|\(c\)[\s\v]*[0-9]|©|all rights reserved)[^\n]*$")
    return _spelled(f"regexp_replace(lower({x}), '{line}', '', 'g')")


def _spelled(t: str) -> str:
    t = f"' ' || trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in L.SPELLINGS:
        t = f"replace({t}, {_q(a.replace('-', ' '))}, {_q(b)})"
    return f"nullif(trim({t}), '')"


def _bare(x: str) -> str:
    """The digest without any copyright line, where a line begins with the word."""
    head = r"^[^\p{L}\p{N}©]*"
    text_goes_on = rf"{head}copyright[ \t\r\f\v]+(notice|holder|owner|licen[cs]e|law|interest)s?([^\p{{L}}\p{{N}}]|$)"
    gone = (rf"regexp_matches(l, '{head}(\(c\)[\s\v]*[0-9]|©|all rights reserved)') OR (regexp_matches(l, '{head}copyright[^\p{{L}}\p{{N}}].*[\p{{L}}\p{{N}}]')"
            rf" AND NOT regexp_matches(l, '{text_goes_on}'))")
    rest = f"array_to_string(list_transform(string_split(lower({x}), chr(10)), lambda l: CASE WHEN {gone} THEN '' ELSE l END), chr(10))"
    return rf"CASE WHEN regexp_matches({x}, '(?im)^[^\p{{L}}\p{{N}}\n©]*copyright') THEN sha256({_spelled(rest)}) END"


def _known(rows) -> str:
    return ", ".join(f"({_q(a)}, {_q(t)})" for a, t in rows)


OP10 = f"""
WITH texts(a, t) AS (VALUES {_known(L.TEXTS)}),
known AS (SELECT a AS license, sha256({_canonical('t')}) AS digest FROM texts UNION SELECT a, {_bare('t')} FROM texts
  UNION SELECT * FROM (VALUES {_known(L.DIGESTS)}) v(a, t)),
notice AS (SELECT DISTINCT a AS license, sha256({_canonical('t')}) AS digest FROM (VALUES {_known(L.NOTICES)}) v(a, t)),
d AS (SELECT doc_id, sha256({_canonical('text')}) AS digest, {_bare('text')} AS bare FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines
          WHERE regexp_matches(line, '(?i)licen[cs]e')) x JOIN notice USING (digest)),
named AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS named FROM found GROUP BY doc_id)
SELECT d.doc_id, d.digest, coalesce(k.license, b.license) AS license, CAST(coalesce(n.n, 0) AS BIGINT) AS n_named, coalesce(n.named, '') AS named
FROM d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN known b ON b.digest = d.bare LEFT JOIN named n ON n.doc_id = d.doc_id"""


def _strength(groups: str, rate: str) -> str:
    """Prior strength of a level, as one value: groups (n, k) around their parents' rates."""
    return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR coalesce(avg({rate} * (1 - {rate})), 0) = 0 THEN 1e6
  WHEN sum(n) - sum(n * n) / sum(n) <= 0 OR sum(n * (k / n - {rate}) * (k / n - {rate})) - sum({rate} * (1 - {rate})) <= 0 THEN 1e6
  ELSE least(1e6, greatest(1.0, avg({rate} * (1 - {rate})) / ((sum(n * (k / n - {rate}) * (k / n - {rate})) - sum({rate} * (1 - {rate})))
    / (sum(n) - sum(n * n) / sum(n))) - 1)) END FROM {groups} WHERE n > 0)"""


OP8 = rf"""
WITH p0 AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p0),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p1),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fit AS (SELECT DISTINCT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) x JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
bad AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k,
  array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
  FROM p LEFT JOIN bad ON doc_id = page_id GROUP BY host),
m AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m0 FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT m0 FROM m) AS up FROM h GROUP BY suffix),
s AS (SELECT suffix, (k + {_strength('s0', 'up')} * up) / (n + {_strength('s0', 'up')}) AS rate FROM s0),
d0 AS (SELECT h.suffix, domain, sum(n) AS n, sum(k) AS k, any_value(rate) AS up FROM h JOIN s ON s.suffix = h.suffix GROUP BY h.suffix, domain),
d AS (SELECT suffix, domain, (k + {_strength('d0', 'up')} * up) / (n + {_strength('d0', 'up')}) AS rate FROM d0),
h0 AS (SELECT host, n, k, rate AS up FROM h JOIN d ON d.domain = h.domain AND d.suffix = h.suffix),
ab AS (SELECT host, k + {_strength('h0', 'up')} * up AS a, n - k + {_strength('h0', 'up')} * (1 - up) AS b FROM h0),
low AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low FROM ab)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN low ON low.host = p.host LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path"""

OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rn, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT k.*, often.key IS NOT NULL AND k.doc_id < often.last AS gone FROM k LEFT JOIN often USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY rn"""
