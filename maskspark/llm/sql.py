"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from maskspark.llm import licenses, mixing

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
drawn AS (SELECT *, CAST('0x' || substr(m, 1, 12) AS BIGINT) AS a, CAST('0x' || substr(m, 13, 12) AS BIGINT) | 1 AS b
  FROM (SELECT *, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)) AS m FROM sized)),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(source_size * {mixing.MAX_RATE} AS DOUBLE) AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level,
  row_number() OVER (ORDER BY cap / weight, rank) AS p FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, p) AS level FROM levels WHERE cap > level * weight),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM final) * weight), cap) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, CAST({mixing.MAX_RATE} AS DOUBLE)) ELSE 0.0 END AS rate FROM targets),
tried AS (SELECT d.source, k, sum(CASE WHEN ((a + k * b) & {2**48 - 1}) / {float(2**48)} < rate - floor(rate) THEN size ELSE 0 END) AS extra
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range({mixing.DRAWS}) AS t(k) GROUP BY ALL),
picks AS (SELECT t.source, arg_min(k, (abs(floor(rate) * source_size + extra - target), k)) AS pick FROM tried t JOIN rates r ON t.source IS NOT DISTINCT FROM r.source GROUP BY t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN ((a + pick * b) & {2**48 - 1}) / {float(2**48)} < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN picks q ON d.source IS NOT DISTINCT FROM q.source
"""

OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS t(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS first FROM places) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, range(13) AS t(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(p) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP8 = f"""
WITH lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _normalized(column: str) -> str:
    t = f"lower(coalesce({column}, ''))"
    t = rf"regexp_replace({t}, '(?m)^[ \t#*/;%\-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by|<)|\(c\)|©)[^\n]*$', '', 'g')"
    t = rf"regexp_replace({t}, '(?m)^[ \t#*/;%\-]*all rights reserved[.]?[ \t\r]*$', '', 'g')"
    t = rf"' ' || replace(trim(regexp_replace({t}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for a, b in licenses.EQUIVALENT:
        a, b = (f" {x} ".replace(" ", "  ")[1:-1] for x in (a, b))
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(replace({t}, '  ', ' '))"


OP10 = f"""
WITH known AS (SELECT sha256({_normalized('t')}) AS digest, min(id) AS license_id FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)}) AS x(id, t) GROUP BY 1),
digests AS (SELECT doc_id, sha256({_normalized('text')}) AS license_digest FROM documents)
SELECT doc_id, license_id, license_digest FROM digests LEFT JOIN known ON license_digest = digest AND digest <> sha256('')
"""
