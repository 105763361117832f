"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import secrets

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
), q AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
), qw AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM q WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM qw))
), m AS (
  SELECT doc_id, i, k, item FROM dw JOIN qw USING (k, s)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b FROM r JOIN links ON node = a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, name: str, pattern: str) -> str:
    return f"SELECT doc_id, {kind} AS kind, '{name}' AS name, regexp_extract_all(t, '{pattern}', 0) AS s, string_split_regex(t, '{pattern}') AS g FROM d"


def _op9() -> str:
    parts = " OR ".join(f"contains(s, '{x}')" for x in secrets.ALLOW_PARTS)
    forms = " OR ".join(f"regexp_matches(s, '{x}')" for x in secrets.ALLOW_FORMS)
    (_, hex_form, hex_window, hex_least), (_, _, window, least) = secrets.CLASSES
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_matches(0, "assign", _ASSIGN)} UNION ALL {_matches(1, "access", secrets.ACCESS)} UNION ALL {_matches(2, "hex", "[0-9a-f]{32,}")} UNION ALL {_matches(3, "entropy", "[A-Za-z0-9+/_=-]{20,}")}),
e AS (
  SELECT doc_id, kind, name, s[i] AS s, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, CAST(len(s) AS BIGINT) + 1)) AS i FROM m)
),
base AS (
  SELECT doc_id, kind, name, start, start + length(s) AS stop FROM e
  WHERE kind = 0 AND length(regexp_extract(s, '{_ASSIGN}', 2)) >= 8 OR kind = 1 AND length(s) >= 16 OR kind = 2
),
c AS (
  SELECT doc_id, s, start, CASE WHEN regexp_matches(s, '{hex_form}') THEN {hex_window} ELSE {window} END AS w, CASE WHEN regexp_matches(s, '{hex_form}') THEN {hex_least} ELSE {least} END AS least
  FROM e WHERE kind = 3 AND regexp_matches(s, '[0-9]') AND NOT ({parts} OR {forms})
),
h AS (
  SELECT doc_id, start + min(i) - 1 AS start, start + max(i) - 1 + w AS stop
  FROM (SELECT *, unnest(range(1, length(s) - w + 2)) AS i FROM c) WHERE list_aggregate(string_split(substring(s, i, w), ''), 'entropy') >= least
  GROUP BY doc_id, start, s, w
),
every AS (
  SELECT * FROM base
  UNION ALL SELECT doc_id, 3, 'entropy', start, stop FROM h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start < h.stop AND h.start < b.stop)
),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM every GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM f
), b AS (
  SELECT *, string_split_regex(o, '<P>|<S>|<M>') AS x FROM o
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256
FROM b
"""

OP13 = rf"""
WITH e AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), k AS (
  SELECT *, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM e
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


ORACLE = {"op2_ngram_jaccard": OP2, "op4_decontamination": OP4, "op9_secret_scan": _op9(), "op12_fill_in_middle": OP12, "op13_line_dedup": OP13}
