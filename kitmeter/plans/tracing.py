"""Registered queries of module resolution, constants, defining files and route trees, over relations made from ``part`` and ``lineitem``.

As in ``adapters``, a relation is one SQL text for Spark and DuckDB. The SQL of a query
is written from the definition: all tries of a specifier with their ranks, and recursive walks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modules, routes, trace
from . import adapters as A
from .queries import query

# --- module resolution

FILES = """
SELECT DISTINCT concat('r', CAST(p_partkey % 4 AS STRING)) AS repo_id,
       concat(CASE p_partkey % 3 WHEN 0 THEN 'lib/' ELSE 'src/' END, 'd', CAST(p_partkey % 7 AS STRING), '/m', CAST(p_partkey % 29 AS STRING),
              CASE p_partkey % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.js' WHEN 4 THEN '.jsx' WHEN 5 THEN '/index.ts' WHEN 6 THEN '/index.jsx' ELSE '.css' END) AS path
FROM part
"""

SPECIFIERS = """
SELECT DISTINCT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('src/d', CAST(l_partkey % 7 AS STRING), '/x', CAST(l_suppkey % 3 AS STRING), '.tsx') AS file,
       concat(CASE l_orderkey % 13 WHEN 0 THEN './m' WHEN 1 THEN '../d3/m' WHEN 2 THEN './../d4/./m' WHEN 3 THEN '@/d2/m' WHEN 4 THEN '@/d1/m' WHEN 5 THEN 'src/d5/m' WHEN 6 THEN 'd6/m'
                               WHEN 7 THEN '../../lib/d1/m' WHEN 8 THEN '@scope/pkg/m' WHEN 9 THEN 'plain/m' WHEN 10 THEN '/rooted/m' WHEN 11 THEN 'exact' ELSE '../../../out/m' END,
              CASE WHEN l_orderkey % 13 = 11 THEN '' ELSE CAST(l_partkey % 29 AS STRING) END, CASE l_linenumber WHEN 1 THEN '.js' WHEN 2 THEN '.jsx' WHEN 3 THEN '.ts' WHEN 4 THEN '/' ELSE '' END) AS source
FROM lineitem
"""

_CONFIGS = [
    ("r0", "", '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"], "@/d1/*": ["/rooted/*", "lib/d1/*", "src/d2/*"], "exact": ["lib/d0/m0", "src/d1/m1", "src/d2/m2"], } } }'),
    ("r1", "", '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*", "../lib/*"], "*/m1": ["d1/m1"]}}} /* end */'),
    ("r2", "config", '{"compilerOptions": {"baseUrl": "../src"}}'),
    ("r3", "", "{ broken"),
]
#: The same patterns: repo, base, head, tail, star, first target, second, third.
_PATTERNS = """
VALUES ('r0', '', '@/', '', TRUE, 'src/*', NULL, NULL), ('r0', '', '@/d1/', '', TRUE, NULL, 'lib/d1/*', 'src/d2/*'), ('r0', '', 'exact', '', FALSE, 'lib/d0/m0', 'src/d1/m1', 'src/d2/m2'),
       ('r1', 'src/', '@/', '', TRUE, 'src/*', 'lib/*', NULL), ('r1', 'src/', '', '/m1', TRUE, 'src/d1/m1', NULL, NULL)
"""

_J2 = rf"""
WITH f AS ({FILES}), s AS ({SPECIFIERS}), a(repo_id, base, head, tail, star, t1, t2, t3) AS ({_PATTERNS}),
best AS (
  SELECT repo_id, source, t1, t2, t3, CASE WHEN star THEN source[length(head) + 1:length(source) - length(tail)] ELSE '' END AS middle
  FROM (SELECT DISTINCT repo_id, source FROM s WHERE source NOT LIKE '.%' AND source NOT LIKE '/%') x JOIN a USING (repo_id)
  WHERE CASE WHEN star THEN starts_with(source, head) AND ends_with(source, tail) AND length(source) >= length(head) + length(tail) ELSE source = head END
  QUALIFY row_number() OVER (PARTITION BY repo_id, source ORDER BY star, -length(head)) = 1
), c AS (
  SELECT repo_id, file, source, 0 AS o, regexp_replace(file, '[^/]*$', '') || source AS p FROM s WHERE source LIKE '.%'
  UNION ALL SELECT repo_id, file, source, 9, CASE repo_id WHEN 'r1' THEN 'src/' WHEN 'r2' THEN 'src/' ELSE '' END || source FROM s WHERE source NOT LIKE '.%' AND source NOT LIKE '/%'
  UNION ALL SELECT repo_id, file, source, o, replace(t, '*', middle) FROM s JOIN best USING (repo_id, source), LATERAL (VALUES (1, t1), (2, t2), (3, t3)) v(o, t) WHERE t IS NOT NULL
), n AS (
  SELECT repo_id, file, source, o, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/\./', '/', 'g'), '^\./', ''), '[^/.]+/\.\./', ''), '[^/.]+/\.\./', ''), '/$', '') AS p FROM c
), tried AS (
  SELECT n.*, v.k, CASE WHEN v.x LIKE '~%' THEN CASE WHEN p LIKE v.own THEN regexp_replace(p, '\.jsx?$', '') || v.x[2:] END ELSE CASE WHEN v.own = '' OR regexp_matches(p, v.own) THEN p || v.x END END AS path
  FROM n, (VALUES (0, '.ts', ''), (1, '.tsx', ''), (2, '.d.ts', ''), (3, '.js', ''), (4, '.jsx', ''), (5, '~.ts', '%.js'), (6, '~.tsx', '%.js'), (7, '~.d.ts', '%.js'), (5, '~.tsx', '%.jsx'), (6, '~.d.ts', '%.jsx'), (8, '', '\.[jt]sx?$'),
                  (9, '/index.ts', ''), (10, '/index.tsx', ''), (11, '/index.d.ts', ''), (12, '/index.js', ''), (13, '/index.jsx', '')) v(k, x, own)
), hit AS (
  SELECT t.repo_id, t.file, source, arg_min(t.path, o * 100 + k) AS target FROM tried t JOIN f ON f.repo_id = t.repo_id AND f.path = t.path GROUP BY ALL
)
SELECT s.repo_id, s.file, s.source, CASE WHEN target IS NOT NULL THEN 'in-repo' WHEN s.source LIKE '.%' OR s.source LIKE '/%' THEN 'unresolved' ELSE 'external' END AS kind,
       CASE WHEN target IS NOT NULL THEN target WHEN s.source NOT LIKE '.%' AND s.source NOT LIKE '/%' THEN regexp_extract(s.source, '^(@[^/]*/[^/]*|[^/]+)', 1) END AS target
FROM s LEFT JOIN hit h ON h.repo_id = s.repo_id AND h.file = s.file AND h.source = s.source
"""


@query(_J2)
def j2_resolve(spark, d):
    """Module resolution (J2) with the aliases of configurations (S14)."""
    configs = spark.createDataFrame(_CONFIGS, "repo_id string, folder string, tsconfig string")
    return modules.resolve(A.run(spark, d, SPECIFIERS), A.run(spark, d, FILES), configs)


# --- constants

_CELL = "SELECT DISTINCT p_partkey % 3 AS r, p_partkey % 20 AS f, p_partkey % 13 AS c FROM part "

CONSTANTS = f"""
SELECT repo_id, file, name, member, kind, CASE kind WHEN 'obj' THEN NULL ELSE text END AS text, CASE WHEN member = '' AND f * c % 3 < 2 THEN c + 1 END AS ord
FROM (
  SELECT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, concat('C', CAST(c AS STRING)) AS name, f, c, '' AS member,
         CASE (f + c) % 7 WHEN 0 THEN 'str' WHEN 1 THEN 'name' WHEN 2 THEN 'obj' WHEN 3 THEN 'member' WHEN 4 THEN 'other' WHEN 5 THEN 'name' ELSE 'obj' END AS kind,
         CASE (f + c) % 7 WHEN 0 THEN concat('/v', CAST(f AS STRING), '-', CAST(c AS STRING)) WHEN 1 THEN concat('C', CAST((c + 1) % 13 AS STRING)) WHEN 3 THEN concat('C', CAST((c + 3) % 13 AS STRING), chr(31), 'b', chr(31), 'c')
                          WHEN 4 THEN 'template-literal' ELSE concat('I', CAST(c AS STRING)) END AS text
  FROM ({_CELL}) x
  UNION ALL
  SELECT concat('r', CAST(r AS STRING)), concat('f', CAST(f AS STRING)), concat('C', CAST(c AS STRING)), f, c, replace(m, '.', chr(31)), k, CASE k WHEN 'str' THEN concat('/', m, CAST(c AS STRING)) ELSE concat(CASE WHEN (f + c) % 2 = 0 THEN 'C' ELSE 'I' END, CAST((c + 2) % 13 AS STRING)) END
  FROM ({_CELL}) x CROSS JOIN (SELECT 'a' AS m, 'str' AS k UNION ALL SELECT 'b', 'obj' UNION ALL SELECT 'b.c', 'str' UNION ALL SELECT 'b.d', 'name') y WHERE (f + c) % 7 IN (2, 6)
) z
"""
BINDINGS = f"""
SELECT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, concat('I', CAST(c AS STRING)) AS local, './x' AS source,
       CASE (f * 2 + c) % 9 WHEN 0 THEN NULL WHEN 1 THEN '*' ELSE concat('C', CAST((c * 5 + 1) % 13 AS STRING)) END AS imported, CASE WHEN (f + c) % 8 > 0 THEN concat('f', CAST((f * 3 + c) % 22 AS STRING)) END AS target
FROM ({_CELL}) x WHERE c < 11
"""
EXPORTS = f"SELECT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, concat('C', CAST((c + 5) % 13 AS STRING)) AS exported, concat('C', CAST(c AS STRING)) AS local, 5 + c AS ord FROM ({_CELL}) x WHERE (f + c) % 5 = 0"
CONSTANT_STARS = f"SELECT DISTINCT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, CASE WHEN f % 9 > 0 THEN concat('f', CAST((f * 7 + c % 2 * 5 + 1) % 20 AS STRING)) END AS target, 3 + c % 2 * 6 AS ord FROM ({_CELL}) x WHERE f % 3 > 0"
PARSED = f"SELECT DISTINCT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file FROM ({_CELL}) x"
WANTED = """
SELECT p_partkey AS id, concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 20 AS STRING)) AS file,
       CASE p_size % 6 WHEN 0 THEN 'str' WHEN 1 THEN 'other' WHEN 2 THEN 'name' WHEN 3 THEN 'obj' ELSE 'member' END AS kind,
       CASE p_size % 6 WHEN 0 THEN p_brand WHEN 1 THEN 'computed' WHEN 3 THEN NULL
                       ELSE concat(CASE WHEN p_partkey % 7 < 4 THEN 'C' ELSE 'I' END, CAST(p_partkey % 13 AS STRING), CASE p_size % 6 WHEN 4 THEN concat(chr(31), 'a') WHEN 5 THEN concat(chr(31), 'b', chr(31), CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'd' END) ELSE '' END) END AS text
FROM part
"""

_T3 = f"""
WITH RECURSIVE k AS ({CONSTANTS}), root AS (SELECT * FROM k WHERE member = ''), b AS ({BINDINGS}), e AS ({EXPORTS}), s AS (SELECT * FROM ({CONSTANT_STARS}) x WHERE target IS NOT NULL), p AS ({PARSED}), q AS ({WANTED}),
way AS (SELECT repo_id, file, name, arg_min(local, ord) AS local, min(ord) AS ord FROM (SELECT repo_id, file, name, '' AS local, ord FROM root WHERE ord IS NOT NULL UNION ALL SELECT repo_id, file, exported, local, ord FROM e) x GROUP BY ALL),
w(id, repo_id, file, name, rest, depth, seen, trail, firm, phase, value, warning, over) AS (
  SELECT id, repo_id, file, CASE WHEN kind IN ('name', 'member') THEN split_part(text, chr(31), 1) ELSE '' END, CASE WHEN kind IN ('name', 'member') THEN string_split(text, chr(31))[2:] ELSE [] END, 0, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), TRUE, 'name',
         CASE kind WHEN 'str' THEN text END, CASE kind WHEN 'other' THEN 'dynamic-path-' || text WHEN 'obj' THEN 'dynamic-path-unsupported' END, kind NOT IN ('name', 'member')
  FROM q
  UNION ALL (
  SELECT id, repo_id, file, name, rest, depth, seen, trail, firm, phase, NULL, 'dynamic-path-depth-exceeded', TRUE FROM w WHERE NOT over AND depth > 5
  UNION ALL
  SELECT id, repo_id, file, CASE WHEN step THEN split_part(text, chr(31), 1) ELSE name END, CASE WHEN step THEN list_concat(string_split(text, chr(31))[2:], rest_left) ELSE rest END, CASE WHEN here THEN depth + n + 1 ELSE depth END, seen, trail, firm, 'name',
         CASE WHEN here AND NOT cycle AND kind = 'str' AND len(rest_left) = 0 AND depth + n + 1 <= 5 THEN text END,
         CASE WHEN cycle THEN 'dynamic-path-cycle' WHEN step THEN NULL WHEN len(rest_left) = 0 AND depth + n + 1 > 5 THEN 'dynamic-path-depth-exceeded'
              WHEN len(rest_left) = 0 AND kind = 'other' THEN 'dynamic-path-' || text WHEN len(rest_left) = 0 AND kind = 'obj' THEN 'dynamic-path-unsupported' WHEN len(rest_left) = 0 THEN NULL
              WHEN kind = 'obj' THEN 'dynamic-path-missing-property' ELSE 'dynamic-path-non-object-segment' END, cycle OR NOT step
  FROM (
    SELECT y.* REPLACE (list_append(seen, own) AS seen), phase = 'name' AND list_contains(seen, own) AS cycle, rest[n + 1:] AS rest_left,
           here AND NOT (phase = 'name' AND list_contains(seen, own)) AND (kind = 'name' OR kind = 'member' AND len(rest) = n) AS step
    FROM (
      SELECT w.*, TRUE AS here, w.file || chr(31) || w.name || chr(31) || array_to_string(rest, chr(31)) AS own, CASE WHEN k2.name IS NOT NULL THEN 2 WHEN k1.name IS NOT NULL THEN 1 ELSE 0 END AS n,
             CASE WHEN k2.name IS NOT NULL THEN k2.kind WHEN k1.name IS NOT NULL THEN k1.kind ELSE root.kind END AS kind, CASE WHEN k2.name IS NOT NULL THEN k2.text WHEN k1.name IS NOT NULL THEN k1.text ELSE root.text END AS text
      FROM w JOIN root ON root.repo_id = w.repo_id AND root.file = w.file AND root.name = w.name
      LEFT JOIN k k1 ON k1.repo_id = w.repo_id AND k1.file = w.file AND k1.name = w.name AND len(rest) > 0 AND k1.member = rest[1]
      LEFT JOIN k k2 ON k2.repo_id = w.repo_id AND k2.file = w.file AND k2.name = w.name AND len(rest) > 1 AND k2.member = rest[1] || chr(31) || rest[2]
      WHERE NOT over AND depth <= 5 AND phase <> 'export'
    ) y
  ) z
  UNION ALL
  SELECT w.id, w.repo_id, CASE WHEN ok THEN b.target ELSE w.file END, CASE WHEN ok THEN CASE WHEN b.imported IS NULL THEN 'default' WHEN b.imported = '*' THEN w.name ELSE b.imported END ELSE w.name END, rest, CASE WHEN ok THEN depth + 1 ELSE depth END, list_append(seen, own), trail, firm, 'export',
         NULL, CASE WHEN cycle THEN 'dynamic-path-cycle' WHEN b.local IS NULL THEN 'dynamic-path-binding-not-found' WHEN b.target IS NULL THEN 'dynamic-path-import-not-in-repo' WHEN p.file IS NULL THEN 'dynamic-path-source-unparseable' END, NOT ok
  FROM (SELECT *, file || chr(31) || name || chr(31) || array_to_string(rest, chr(31)) AS own, list_contains(seen, file || chr(31) || name || chr(31) || array_to_string(rest, chr(31))) AS cycle FROM w WHERE NOT over AND depth <= 5 AND phase = 'name') w
  LEFT JOIN b ON b.repo_id = w.repo_id AND b.file = w.file AND b.local = w.name LEFT JOIN p ON p.repo_id = w.repo_id AND p.file = b.target, LATERAL (SELECT NOT cycle AND p.file IS NOT NULL AS ok) o
  WHERE NOT EXISTS (SELECT 1 FROM root WHERE root.repo_id = w.repo_id AND root.file = w.file AND root.name = w.name)
  UNION ALL
  SELECT w.id, w.repo_id, w.file, CASE WHEN way.local <> '' THEN way.local ELSE w.name END, rest, depth, seen, list_append(trail, coalesce(way.ord, 1000000)), firm, CASE WHEN way.local = '' THEN 'constant' ELSE 'name' END, NULL,
         CASE WHEN way.name IS NULL THEN 'dynamic-path-export-not-found' END, way.name IS NULL
  FROM w LEFT JOIN way ON way.repo_id = w.repo_id AND way.file = w.file AND way.name = w.name WHERE NOT over AND depth <= 5 AND phase = 'export'
  UNION ALL
  SELECT w.id, w.repo_id, s.target, w.name, rest, depth + 1, seen, list_append(trail, s.ord), FALSE, 'export', NULL, NULL, FALSE
  FROM w JOIN s ON s.repo_id = w.repo_id AND s.file = w.file LEFT JOIN way ON way.repo_id = w.repo_id AND way.file = w.file AND way.name = w.name
  WHERE NOT over AND depth <= 5 AND phase = 'export' AND s.ord < coalesce(way.ord, 1000000)
  )
)
SELECT id, arg_min(value, trail) FILTER (value IS NOT NULL) AS value, CASE WHEN count(value) = 0 THEN max(warning) FILTER (firm) END AS warning FROM w WHERE over GROUP BY id
"""


@query(_T3)
def t3_constants(spark, d):
    """Path constants (T3): names, members and objects, through imports, lists and stars."""
    return trace.constants(*[A.run(spark, d, x) for x in (WANTED, CONSTANTS, BINDINGS, EXPORTS, CONSTANT_STARS, PARSED)])


# --- defining files

CHASE_OWN = f"SELECT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, concat('S', CAST(c AS STRING)) AS symbol FROM ({_CELL}) x WHERE (f * 5 + c) % 11 = 0"
CHASE_NAMED = f"""
SELECT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, concat('S', CAST(c AS STRING)) AS exported, concat('S', CAST((c + f % 2) % 13 AS STRING)) AS local,
       CASE WHEN (f + c) % 7 > 0 THEN concat('f', CAST((f * 3 + c) % 22 AS STRING)) END AS target, 2 + c AS ord FROM ({_CELL}) x WHERE (f + 2 * c) % 3 = 1
"""
CHASE_STARS = f"SELECT DISTINCT concat('r', CAST(r AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, CASE WHEN f % 9 > 0 THEN concat('f', CAST((f * 7 + c % 3 * 5 + 1) % 20 AS STRING)) END AS target, 1 + c % 3 * 5 AS ord FROM ({_CELL}) x WHERE f % 4 > 0"
CHASED = "SELECT DISTINCT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_size % 20 AS STRING)) AS file, concat('S', CAST(p_partkey % 13 AS STRING)) AS symbol FROM part"


def _chase_sql(steps: int = trace.CHASE_DEPTH + 1) -> str:
    """Levels of the walk down, then the fold back up."""
    first = "SELECT repo_id, file, exported, arg_min(struct_pack(t := target, l := local), ord) AS n, min(ord) AS ord FROM named GROUP BY ALL"
    parts = [f"own AS ({CHASE_OWN})", f"named AS ({CHASE_NAMED})", f"stars AS (SELECT * FROM ({CHASE_STARS}) x WHERE target IS NOT NULL)", f"first AS ({first})"]
    parts.append(f"l0 AS (SELECT repo_id, file AS root, symbol AS want, file, symbol, CAST([] AS BIGINT[]) AS trail, [file || ':' || symbol] AS seen, FALSE AS star, FALSE AS back FROM ({CHASED}) x)")
    for k in range(steps):
        step = f"""
SELECT l.repo_id, root, want, n.t AS file, n.l AS symbol, list_append(trail, ord) AS trail, seen, FALSE AS star FROM l{k} l JOIN first USING (repo_id, file) WHERE exported = symbol AND n.t IS NOT NULL AND NOT back
UNION ALL
SELECT l.repo_id, root, want, s.target, symbol, list_append(trail, s.ord), seen, TRUE FROM l{k} l JOIN stars s ON s.repo_id = l.repo_id AND s.file = l.file
LEFT JOIN first f ON f.repo_id = l.repo_id AND f.file = l.file AND f.exported = symbol WHERE NOT back AND s.ord < coalesce(f.ord, 1000000)"""
        parts.append(f"l{k + 1} AS (SELECT * REPLACE (list_append(seen, file || ':' || symbol) AS seen), list_contains(seen, file || ':' || symbol) AS back FROM ({step}) x)")
    for k in range(steps, -1, -1):
        hit = f"(SELECT repo_id, root, want, trail[:-2] AS trail, arg_min(struct_pack(f := ef, s := es), trail[-1]) AS h FROM e{k + 1} WHERE counts GROUP BY ALL)" if k < steps else "(SELECT NULL AS repo_id, NULL AS root, NULL AS want, CAST(NULL AS BIGINT[]) AS trail, NULL AS h WHERE FALSE)"
        end = "coalesce(h.h.f, l.file)", "coalesce(h.h.s, l.symbol)"
        if k == steps:
            end = "l.file", "l.symbol"
        owns = "EXISTS (SELECT 1 FROM own o WHERE o.repo_id = l.repo_id AND o.file = l.file AND o.symbol = l.symbol)"
        parts.append(f"e{k} AS (SELECT l.repo_id, l.root, l.want, l.trail, {end[0]} AS ef, {end[1]} AS es, NOT star OR {owns} OR {end[0]} <> l.file AS counts FROM l{k} l LEFT JOIN {hit} h ON h.repo_id = l.repo_id AND h.root = l.root AND h.want = l.want AND h.trail = l.trail)")
    return f"WITH {', '.join(parts)} SELECT repo_id, root AS file, want AS symbol, ef AS def_file, es AS def_symbol FROM e0"


@query(_chase_sql())
def c5_chase(spark, d):
    """Defining files (C5)."""
    return trace.defining_file(*[A.run(spark, d, x) for x in (CHASED, CHASE_NAMED, CHASE_STARS, CHASE_OWN)])


# --- route trees

NODES = """
SELECT concat('r', CAST(f % 3 AS STRING)) AS repo_id, concat('f', CAST(f AS STRING)) AS file, CAST(j AS INT) AS node, CASE WHEN j % 11 > 0 THEN CAST(floor((j - 1) / 2) AS INT) END AS parent,
       CASE (f + j) % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('/abs', CAST(j AS STRING)) WHEN 3 THEN '/' ELSE concat('s', CAST(j AS STRING)) END AS segment
FROM (SELECT p_partkey % 40 AS f, CAST(floor(p_partkey / 40) AS INT) AS j FROM part ) x
"""


@query(f"""
WITH RECURSIVE n AS ({NODES}), w(repo_id, file, node, path) AS (
  SELECT repo_id, file, node, CASE WHEN segment IS NULL THEN '' WHEN segment = '' THEN '/' WHEN segment LIKE '/%' THEN segment ELSE '/' || segment END FROM n WHERE parent IS NULL
  UNION ALL
  SELECT n.repo_id, n.file, n.node, CASE WHEN segment IS NULL THEN path WHEN segment = '' THEN CASE path WHEN '' THEN '/' ELSE path END WHEN segment LIKE '/%' THEN segment ELSE regexp_replace(path, '/$', '') || '/' || segment END
  FROM w JOIN n ON n.repo_id = w.repo_id AND n.file = w.file AND n.parent = w.node
) SELECT * FROM w""")
def t2_tree_walk(spark, d):
    """Paths of route trees (T2): pathless nodes, index nodes, absolute paths."""
    return routes.tree_paths(A.run(spark, d, NODES))


PAGES = """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 20 AS STRING)) AS file, p_partkey AS node,
       CASE p_partkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'lazy' WHEN 3 THEN 'name' ELSE 'names' END AS page,
       CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'conditional-element' WHEN 2 THEN concat('./l', CAST(p_size % 9 AS STRING)) WHEN 3 THEN concat('I', CAST(p_size % 14 AS STRING)) WHEN 4 THEN ''
                          ELSE concat('I', CAST(p_size % 14 AS STRING), ',I', CAST(p_partkey % 14 AS STRING), '.Item,I', CAST(p_size % 5 AS STRING)) END AS names
FROM part
"""
LAZY = "SELECT DISTINCT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 20 AS STRING)) AS file, concat('./l', CAST(p_size % 9 AS STRING)) AS source, CASE WHEN p_size % 9 % 2 = 0 THEN 'in-repo' ELSE 'unresolved' END AS kind, CASE WHEN p_size % 9 % 2 = 0 THEN concat('L', CAST(p_size % 9 AS STRING)) END AS target FROM part"


@query(f"""
WITH n AS ({PAGES}), b AS ({BINDINGS}), l AS ({LAZY}), t AS (
  SELECT n.repo_id, n.file, node, n.page, k, tag, contains(tag, '.') AS member, b.local, b.source, b.imported, b.target, split_part(tag, '.', 1) AS head
  FROM n, LATERAL (SELECT unnest(string_split(names, ',')) AS tag, unnest(range(1, len(string_split(names, ',')) + 1)) AS k) u LEFT JOIN b ON b.repo_id = n.repo_id AND b.file = n.file AND b.local = split_part(tag, '.', 1)
  WHERE n.page IN ('name', 'names') AND names <> ''
), j AS (
  SELECT *, CASE WHEN target IS NOT NULL THEN NULL WHEN local IS NULL AND member THEN 'jsx-member-base-not-imported:' || head || ' of ' || tag WHEN local IS NULL THEN 'page-not-imported:' || tag
                 WHEN member THEN 'jsx-member-unresolved:' || tag || ', as ' || head || ' is from ' || source ELSE 'page-import-not-in-repo:' || tag || ', ' || source || ' is elsewhere' END AS warning
  FROM t QUALIFY row_number() OVER (PARTITION BY repo_id, file, node ORDER BY target IS NULL, k) = 1
)
SELECT repo_id, file, node, target AS page, CASE WHEN target IS NULL THEN CASE page WHEN 'name' THEN tag END WHEN member THEN tag ELSE coalesce(imported, tag) END AS symbol, warning FROM j
UNION ALL SELECT n.repo_id, n.file, node, l.target, CASE WHEN l.target IS NOT NULL THEN 'default' END, CASE WHEN l.target IS NULL THEN 'lazy-import-not-in-repo' END FROM n LEFT JOIN l ON l.repo_id = n.repo_id AND l.file = n.file AND l.source = names WHERE n.page = 'lazy'
UNION ALL SELECT repo_id, file, node, NULL, NULL, CASE page WHEN 'dynamic' THEN 'page-unresolved:' || names WHEN 'names' THEN 'no-jsx-candidate-resolved' END FROM n WHERE page IN ('none', 'dynamic') OR page = 'names' AND names = ''
""")  # fmt: skip
def t5_pages(spark, d):
    """Pages of route nodes (T5): the first candidate that is a file of the repo, else the first warning."""
    nodes = A.run(spark, d, PAGES).withColumn("names", F.when(F.col("names") == "", F.array().cast("array<string>")).otherwise(F.split("names", ",")))
    return routes.pages(nodes, A.run(spark, d, BINDINGS), A.run(spark, d, LAZY))
