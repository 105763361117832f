"""Registered queries of the joins, closures, route steps and extractors, over relations made from the driver's tables.

As in ``adapters``, a relation is one SQL text for Spark and DuckDB; sources to extract
from are built by rule from ``part`` and ``nation``, so that their facts can be told in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import closures, counters, joins, recommend, routes, rules
from ..operators.recommend import Thresholds
from ..session import checkpoint
from . import adapters as A
from . import scan as S
from .facts import spread
from .queries import query

BINDING = """
SELECT DISTINCT concat('r', CAST(p_partkey % 7 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 53 AS STRING)) AS file, concat('L', CAST(p_partkey % 11 AS STRING)) AS local,
       CASE (p_partkey % 7 + p_partkey % 53 + p_partkey % 11) % 4 WHEN 0 THEN './local' WHEN 1 THEN concat('@ds/p', CAST(p_partkey % 11 AS STRING)) WHEN 2 THEN 'react' ELSE '@kit/core/x' END AS source,
       CASE p_partkey % 11 % 3 WHEN 0 THEN NULL WHEN 1 THEN '*' ELSE concat('S', CAST(p_partkey % 11 AS STRING)) END AS imported, p_partkey % 11 % 3 = 1 AS is_namespace
FROM part
"""

TAGS = """
SELECT concat('r', CAST(l_partkey % 7 AS STRING)) AS repo_id, concat('f', CAST(l_orderkey % 61 AS STRING)) AS file,
       concat('L', CAST(l_suppkey % 13 AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '.Item' WHEN 1 THEN ':x' ELSE '' END) AS tag, l_quantity AS quantity
FROM lineitem
"""


@query(f"WITH u AS ({TAGS}), b AS ({BINDING}) SELECT tag, source, imported, is_namespace, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity FROM u LEFT JOIN b ON u.repo_id = b.repo_id AND u.file = b.file AND b.local = regexp_extract(tag, '^([^.:]*)', 1) GROUP BY 1, 2, 3, 4")
def j1_bind(spark, d):
    found = joins.bind(A.run(spark, d, TAGS), A.run(spark, d, BINDING))
    return found.groupBy("tag", "source", "imported", "is_namespace").agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"))


IMPORTS = """
SELECT p_partkey AS import_id, concat('r', CAST(p_partkey % 7 AS STRING)) AS repo_id, CASE p_partkey % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'in-repo' ELSE 'unresolved' END AS kind, p_brand AS target,
       CASE p_partkey % 4 WHEN 0 THEN concat('@kit/', CAST(p_size AS STRING)) WHEN 1 THEN concat('./c', CAST(p_size AS STRING)) ELSE p_brand END AS source,
       CASE WHEN p_partkey % 3 = 1 THEN concat('libs/k', CAST(p_size % 6 AS STRING), '/f', CAST(p_partkey AS STRING)) END AS resolved_file,
       CASE WHEN p_size % 5 > 0 THEN concat('S', CAST(p_size % 5 AS STRING)) END AS imported
FROM part
"""


@query(f"WITH i AS ({IMPORTS}), k AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_brand LIKE '%3') SELECT import_id, CASE WHEN kind = 'external' THEN target END AS package, kind = 'external' AND target IN (SELECT package FROM k) AS is_ds_package FROM i")
def j3_ds_match(spark, d):
    packages = A.run(spark, d, "SELECT DISTINCT p_brand AS package FROM part WHERE p_brand LIKE '%3'")
    return joins.ds_match(A.run(spark, d, IMPORTS), packages).select("import_id", "package", "is_ds_package")


LIBRARIES = """
SELECT concat('r', CAST(s_suppkey % 7 AS STRING)) AS repo_id, concat('lib', CAST(s_suppkey % 5 AS STRING)) AS lib_id, concat('^@kit/', CAST(s_suppkey % 5 AS STRING), '.*$') AS pattern,
       concat('libs/k', CAST(s_suppkey % 5 AS STRING), '/') AS prefix, CASE s_suppkey % 5 % 2 WHEN 0 THEN 'partially-backed' ELSE 'own' END AS kind, min(s_suppkey) AS ord
FROM supplier GROUP BY s_suppkey % 7, s_suppkey % 5
"""
_MATCH = f"WITH i AS ({IMPORTS}), l AS ({LIBRARIES}), m AS (SELECT i.import_id, i.repo_id, i.imported, lib_id, l.kind AS lib_kind, row_number() OVER (PARTITION BY i.import_id ORDER BY ord) AS k FROM i JOIN l ON i.repo_id = l.repo_id AND (regexp_matches(source, pattern) OR coalesce(starts_with(resolved_file, prefix), FALSE)))"


@query(f"{_MATCH} SELECT import_id, lib_id, lib_kind FROM m WHERE k = 1")
def j5_library_match(spark, d):
    return joins.match_library(A.run(spark, d, IMPORTS).select("import_id", "repo_id", "source", "resolved_file"), A.run(spark, d, LIBRARIES))


BACKED = """
SELECT concat('r', CAST(s_suppkey % 7 AS STRING)) AS repo_id, concat('lib', CAST(s_suppkey % 5 AS STRING)) AS lib_id, concat('S', CAST(s_suppkey % 3 AS STRING)) AS symbol, count(*) % 2 = 0 AS backed
FROM supplier GROUP BY s_suppkey % 7, s_suppkey % 5, s_suppkey % 3
"""


@query(f"{_MATCH}, b AS ({BACKED}) SELECT import_id, m.lib_id, coalesce(backed, lib_kind = 'partially-backed') AS lib_backed FROM m LEFT JOIN b ON m.repo_id = b.repo_id AND m.lib_id = b.lib_id AND coalesce(imported, 'default') = symbol WHERE k = 1")
def j6_library_backing(spark, d):
    i = A.run(spark, d, IMPORTS)
    matched = joins.match_library(i.select("import_id", "repo_id", "source", "resolved_file"), A.run(spark, d, LIBRARIES)).join(i.select("import_id", "repo_id", "imported"), "import_id")
    return joins.library_backing(matched, A.run(spark, d, BACKED)).select("import_id", "lib_id", "lib_backed")


@query(f"WITH u AS ({TAGS}) SELECT tag, file, quantity > 25 AS in_library, CASE WHEN quantity % 2 = 0 THEN tag WHEN quantity <= 25 AND contains(tag, '.') THEN regexp_extract(tag, '([^.]*)$', 1) ELSE coalesce(CASE WHEN quantity % 3 = 0 THEN 'Named' END, 'default') END AS symbol, count(*) AS n FROM u GROUP BY ALL")
def j8_defining_symbol(spark, d):
    library, bound = F.col("quantity") > 25, F.col("quantity") % 2 != 0
    symbol = joins.defining_symbol(F.col("tag"), F.when(F.col("quantity") % 3 == 0, "Named"), library, bound)
    return A.run(spark, d, TAGS).groupBy("tag", "file", library.alias("in_library"), symbol.alias("symbol")).agg(F.count("*").alias("n"))


FILE_ROUTES = """
SELECT concat('r', CAST(p_partkey % 7 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 53 AS STRING)) AS file, count(DISTINCT p_size % 3) AS n,
       min(concat('/', CAST(p_size % 3 AS STRING))) AS low, max(concat('/', CAST(p_size % 3 AS STRING))) AS high
FROM part GROUP BY p_partkey % 7, p_partkey % 53
"""


def _file_routes(spark, d) -> DataFrame:
    n = F.col("n")
    route = F.struct(F.when(n > 1, "shared").otherwise("bound").alias("kind"), F.when(n == 1, F.col("low")).alias("path"), F.when(n > 1, F.array("low", "high")).alias("paths"))
    return A.run(spark, d, FILE_ROUTES).select("repo_id", "file", route.alias("route"))


@query(f"WITH u AS ({TAGS}), f AS ({FILE_ROUTES}) SELECT u.repo_id, u.file AS file_path, CASE WHEN f.n > 1 THEN 'shared' WHEN f.n = 1 THEN 'bound' ELSE 'unsupported' END AS kind, CASE WHEN f.n = 1 THEN low END AS path, CASE WHEN f.n > 1 THEN concat(low, ',', high) END AS paths, count(*) AS usages FROM u LEFT JOIN f ON u.repo_id = f.repo_id AND u.file = f.file GROUP BY ALL")
def j9_apply_routes(spark, d):
    u = A.run(spark, d, TAGS).withColumnRenamed("file", "file_path")
    found = routes.apply_routes(u, _file_routes(spark, d)).select("repo_id", "file_path", "route.kind", "route.path", F.array_join("route.paths", ",").alias("paths"))
    return found.groupBy(*found.columns).agg(F.count("*").alias("usages"))


@query(f"WITH s AS (SELECT DISTINCT repo_id, file AS file_path, tag FROM ({TAGS}) t), f AS ({FILE_ROUTES}) SELECT s.repo_id, file_path, tag, CASE WHEN f.n > 1 AND tag NOT LIKE '%.Item' THEN 'a,multi-route' WHEN tag LIKE '%.Item' THEN 'multi-route' ELSE 'a' END AS signals FROM s LEFT JOIN f ON s.repo_id = f.repo_id AND file_path = f.file")
def j10_mark_multi_route(spark, d):
    s = A.run(spark, d, TAGS).select("repo_id", F.col("file").alias("file_path"), "tag").distinct().withColumn("signals", F.array(F.when(F.endswith("tag", F.lit(".Item")), "multi-route").otherwise("a")))
    return routes.mark_multi_route(s, _file_routes(spark, d)).withColumn("signals", F.array_join("signals", ","))


@query("WITH s AS (SELECT concat('lib', s_suppkey % 9) AS lib_id, concat('S', s_suppkey % 4) AS symbol, min(s_acctbal) > 0 AS backed FROM supplier GROUP BY 1, 2), o AS (SELECT concat('lib', s_suppkey % 4) AS lib_id, concat('S', s_suppkey % 6) AS symbol, max(s_acctbal) > 0 AS backed FROM supplier GROUP BY 1, 2) SELECT 'symbol' AS what, * FROM o UNION ALL SELECT 'symbol', * FROM s WHERE lib_id NOT IN (SELECT lib_id FROM o) UNION ALL SELECT DISTINCT 'failed', concat('lib', s_nationkey), NULL, NULL FROM supplier")
def j12_override_registries(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lib = lambda m, n, low: s.groupBy(F.concat(F.lit("lib"), F.col("s_suppkey") % m).alias("lib_id"), F.concat(F.lit("S"), F.col("s_suppkey") % n).alias("symbol")).agg(((F.min if low else F.max)("s_acctbal") > 0).alias("backed"))
    symbols, failed = joins.override_registries(lib(9, 4, True), lib(4, 6, False), s.select(F.concat(F.lit("lib"), "s_nationkey").alias("lib_id")))
    return symbols.select(F.lit("symbol").alias("what"), "*").unionByName(failed.select(F.lit("failed").alias("what"), "lib_id"), allowMissingColumns=True)


@query(f"WITH u AS ({A.USAGE}), c AS (SELECT ds_package AS package, count(DISTINCT repo_id) AS repos_using, count(*) AS instances FROM u WHERE category = 'ds' GROUP BY 1), e AS (SELECT DISTINCT p_brand AS package FROM part UNION SELECT p_type FROM part) SELECT package, repos_using, instances FROM e JOIN c USING (package)")
def j13_evidence(spark, d):
    from ..operators import metrics

    part = spark.read.parquet(f"{d}/part.parquet")
    named = part.select(F.col("p_brand").alias("package")).union(part.select("p_type")).distinct()
    return joins.evidence_values(named, metrics.coverage(A.usage(spark, d)), "package")


# --- the last word on usages: J7, B0, P1

STAGED = """
SELECT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('d', CAST(l_partkey % 90 AS STRING)) AS def_file, concat('S', CAST(l_linenumber AS STRING)) AS symbol, CAST(1 + l_orderkey % 8 AS INT) AS rule,
       l_orderkey % 8 IN (3, 4, 5, 7) AS pending, CASE WHEN l_orderkey % 8 IN (0, 6) THEN 'neither' WHEN l_orderkey % 8 IN (1, 2) THEN 'adoption' END AS bucket,
       CASE WHEN l_orderkey % 8 IN (0, 6) THEN 'utility-heuristic' WHEN l_orderkey % 8 = 1 THEN 'direct-ds' WHEN l_orderkey % 8 = 2 THEN 'ds-backed-wrapper' END AS classification_source
FROM lineitem
"""
_ALIASES = "SELECT DISTINCT repo_id, def_file, symbol, concat(repo_id, substr(def_file, 1, 2), symbol) AS profile_id FROM ({}) x WHERE symbol <> 'S7' AND def_file NOT LIKE '%3'"
_VERDICT = "SELECT DISTINCT profile_id, CASE substr(profile_id, 4, 1) WHEN '1' THEN 'adoption' WHEN '2' THEN 'neither' ELSE 'shadow' END AS b_bucket, CASE substr(profile_id, 4, 1) WHEN '1' THEN 'ds-composition' WHEN '2' THEN 'utility-heuristic' ELSE 'parallel-local-ui' END AS b_source, CASE WHEN substr(profile_id, 4, 1) NOT IN ('1', '2') THEN 'likely' END AS b_level FROM ({}) y"
_ALIAS_SQL = _ALIASES.format(STAGED)


@query(f"WITH s AS ({STAGED}), a AS ({_ALIAS_SQL}), v AS ({_VERDICT.format(_ALIAS_SQL)}) SELECT rule, coalesce(bucket, b_bucket, CASE WHEN rule = 4 THEN 'shadow' ELSE 'neither' END) AS bucket, coalesce(classification_source, b_source, CASE WHEN rule = 4 THEN 'parallel-local-ui' ELSE 'utility-heuristic' END) AS classification_source, CASE WHEN pending THEN coalesce(b_level, CASE WHEN rule = 4 AND a.profile_id IS NULL THEN 'possible' END) END AS shadow_level, a.profile_id IS NULL AS lost, count(*) AS n FROM s LEFT JOIN a USING (repo_id, def_file, symbol) LEFT JOIN v USING (profile_id) GROUP BY ALL")
def b0_finalise(spark, d):
    s = A.run(spark, d, STAGED)
    aliases = s.where("symbol <> 'S7' AND def_file NOT LIKE '%3'").select("repo_id", "def_file", "symbol", F.concat("repo_id", F.substring("def_file", 1, 2), "symbol").alias("profile_id")).distinct()
    kind = F.substring("profile_id", 4, 1)
    verdict = aliases.select("profile_id", F.when(kind == "1", "adoption").when(kind == "2", "neither").otherwise("shadow").alias("b_bucket"), F.when(kind == "1", "ds-composition").when(kind == "2", "utility-heuristic").otherwise("parallel-local-ui").alias("b_source"), F.when(~kind.isin("1", "2"), "likely").alias("b_level")).distinct()
    done = rules.finalise(s, aliases, verdict)
    return done.groupBy("rule", "bucket", "classification_source", "shadow_level", F.col("profile_id").isNull().alias("lost")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Own' WHEN 1 THEN '' ELSE 'Button,Card' END AS primitives FROM nation")
def r5_primitives(spark, d):
    own = F.when(F.col("n_regionkey") == 0, F.array(F.lit("Own"))).when(F.col("n_regionkey") == 1, F.array().cast("array<string>"))
    found = rules.primitives_of(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("repo_id"), own.alias("own")), ["Button", "Card"])
    return found.select(F.col("repo_id").alias("n_nationkey"), F.array_join("primitives", ",").alias("primitives"))


@query(f"WITH p AS ({A.PROFILE}) SELECT repo_id, file_path, component_name, n AS usage_count, array_to_string(string_split(file_path, '/')[1:-2], '/') AS segments, CASE WHEN file_path LIKE '%features/%' THEN 'cart' END AS feature FROM (SELECT repo_id, file_path, component_name, profile_id % 3 AS n FROM p WHERE has_ds_import UNION ALL SELECT repo_id, file_path, 'Lib', 7 FROM p WHERE uses_styled) z WHERE n > 0")
def p2_shadow_rows(spark, d):
    p = A.run(spark, d, A.PROFILE)
    judged = p.withColumns({"bucket": F.when(F.col("has_ds_import"), "shadow").otherwise("neither"), "usage_count": F.col("profile_id") % 3})
    synthetic = p.where("uses_styled").select("repo_id", "file_path", F.lit("Lib").alias("component_name"), F.lit(7).cast("long").alias("usage_count"))
    found = counters.shadow_rows(judged, synthetic, ["repo_id", "file_path", "component_name", "usage_count", "directory_segments", "feature"])
    return found.withColumn("segments", F.array_join("directory_segments", "/")).drop("directory_segments")


# --- closures

_STEPS = """
OWN AS (SELECT DISTINCT concat('p', CAST(p_partkey % 40 AS STRING)) AS pkg, concat('S', CAST(p_partkey % 17 AS STRING)) AS symbol FROM part WHERE p_partkey % 40 % 3 = 0),
NAMED AS (SELECT concat('p', CAST(k AS STRING)) AS pkg, concat('N', CAST(s AS STRING)) AS symbol, concat('p', CAST(k + 1 + s % 4 AS STRING)) AS from_pkg, CASE WHEN s % 2 = 0 THEN concat('S', CAST((k + s) % 17 AS STRING)) ELSE concat('N', CAST(s AS STRING)) END AS from_symbol
          FROM (SELECT DISTINCT p_partkey % 40 AS k, p_partkey % 9 AS s FROM part ) x WHERE (k + s) % 4 < 3),
STARS AS (SELECT DISTINCT concat('p', CAST(p_partkey % 40 AS STRING)) AS pkg, concat('p', CAST(p_partkey % 40 + 1 + p_partkey % 3 AS STRING)) AS from_pkg, p_partkey % 3 AS ord FROM part WHERE p_partkey % 40 % 2 = 1)
"""


def _relation(spark, d, name: str) -> DataFrame:
    body = _STEPS.split(f"{name} AS (", 1)[1]
    depth, at = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(body[at], 0)
        at += 1
    return A.run(spark, d, body[: at - 1])


_TRACE = f"""
WITH RECURSIVE {_STEPS}, way AS (
  SELECT pkg, symbol, from_pkg, from_symbol, 1 AS kind, 0 AS ord FROM NAMED
), t(pkg, symbol, place, want, seen, path, hops) AS (
  SELECT pkg, symbol, from_pkg, from_symbol, [pkg], '', 1 FROM NAMED
  UNION ALL
  SELECT t.pkg, t.symbol, x.from_pkg, coalesce(x.from_symbol, t.want), list_append(t.seen, t.place), t.path || x.ord, t.hops + 1
  FROM t JOIN (SELECT pkg, symbol, from_pkg, from_symbol, ord FROM way UNION ALL SELECT pkg, NULL, from_pkg, NULL, ord FROM STARS) x
    ON x.pkg = t.place AND (x.symbol = t.want OR x.symbol IS NULL AND NOT EXISTS (SELECT 1 FROM NAMED n WHERE n.pkg = t.place AND n.symbol = t.want))
  WHERE t.hops < 6 AND NOT list_contains(t.seen, t.place) AND NOT EXISTS (SELECT 1 FROM OWN o WHERE o.pkg = t.place AND o.symbol = t.want)
), hit AS (
  SELECT t.pkg, t.symbol, t.place AS source_pkg, t.want AS source_symbol, t.hops, 1 AS rank, path AS k FROM t JOIN OWN o ON o.pkg = t.place AND o.symbol = t.want WHERE NOT list_contains(t.seen, t.place)
  UNION ALL SELECT pkg, symbol, pkg, symbol, 0, 0, '' FROM OWN
  UNION ALL SELECT s.pkg, o.symbol, o.pkg, o.symbol, 1, 2, CAST(s.ord AS VARCHAR) FROM STARS s JOIN OWN o ON o.pkg = s.from_pkg
)
SELECT pkg, symbol, source_pkg, source_symbol, hops FROM (SELECT *, row_number() OVER (PARTITION BY pkg, symbol ORDER BY rank, k, source_pkg) AS n FROM hit) h WHERE n = 1
"""


@query(_TRACE)
def c1_reexports(spark, d):
    """Flattened re-exports (C1), whose named ones are traced (C2)."""
    return closures.reexport_closure(_relation(spark, d, "OWN"), _relation(spark, d, "NAMED"), _relation(spark, d, "STARS"))


_LIB = """
OWN AS (SELECT DISTINCT concat('k', CAST(p_partkey % 3 AS STRING)) AS lib_id, concat('f', CAST(p_partkey % 40 AS STRING)) AS file, concat('S', CAST(p_partkey % 17 AS STRING)) AS symbol FROM part WHERE p_partkey % 40 % 4 = 0),
FILES AS (SELECT DISTINCT concat('k', CAST(p_partkey % 3 AS STRING)) AS lib_id, concat('f', CAST(p_partkey % 40 AS STRING)) AS file, (p_partkey % 3 + p_partkey % 40) % 3 = 0 AS imports_ds FROM part),
NAMED AS (SELECT DISTINCT concat('k', CAST(p_partkey % 3 AS STRING)) AS lib_id, concat('f', CAST(p_partkey % 40 AS STRING)) AS file, concat('N', CAST(p_partkey % 13 AS STRING)) AS symbol, concat('f', CAST(p_partkey * 7 % 40 AS STRING)) AS target, CASE WHEN p_partkey % 2 = 0 THEN concat('S', CAST(p_partkey % 17 AS STRING)) ELSE concat('N', CAST((p_partkey + 1) % 13 AS STRING)) END AS local FROM part),
STARS AS (SELECT DISTINCT concat('k', CAST(p_partkey % 3 AS STRING)) AS lib_id, concat('f', CAST(p_partkey % 40 AS STRING)) AS file, concat('f', CAST((p_partkey * 5 + 1) % 40 AS STRING)) AS target FROM part WHERE p_partkey % 6 = 0)
"""


def _lib(spark, d, name: str) -> DataFrame:
    line = next(x for x in _LIB.strip().splitlines() if x.startswith(name))
    return A.run(spark, d, line.split(" AS (", 1)[1].rstrip(",").removesuffix(")"))


@query(f"""
WITH RECURSIVE {_LIB}, e AS (SELECT lib_id, file, symbol, target, local FROM NAMED UNION ALL SELECT lib_id, file, NULL, target, NULL FROM STARS), t(lib_id, symbol, place, want, hops) AS (
  SELECT lib_id, symbol, target, local, 0 FROM NAMED
  UNION SELECT t.lib_id, t.symbol, e.target, coalesce(e.local, t.want), t.hops + 1 FROM t JOIN e ON e.lib_id = t.lib_id AND e.file = t.place AND (e.symbol = t.want OR e.symbol IS NULL)
  WHERE t.hops < 5 AND NOT EXISTS (SELECT 1 FROM OWN o WHERE o.lib_id = t.lib_id AND o.file = t.place AND o.symbol = t.want)
), every AS (
  SELECT t.lib_id, t.symbol, f.imports_ds AND o.symbol IS NOT NULL AS backed FROM t LEFT JOIN OWN o ON o.lib_id = t.lib_id AND o.file = t.place AND o.symbol = t.want LEFT JOIN FILES f ON f.lib_id = t.lib_id AND f.file = t.place
  UNION ALL SELECT o.lib_id, o.symbol, f.imports_ds FROM OWN o JOIN FILES f USING (lib_id, file)
  UNION ALL SELECT o.lib_id, o.symbol, f.imports_ds FROM STARS s JOIN OWN o ON o.lib_id = s.lib_id AND o.file = s.target JOIN FILES f ON f.lib_id = o.lib_id AND f.file = o.file
) SELECT lib_id, symbol, bool_or(coalesce(backed, FALSE)) AS backed FROM every GROUP BY 1, 2""")
def c3_backing(spark, d):
    return closures.backing_closure(*[_lib(spark, d, x) for x in ("OWN", "FILES", "NAMED", "STARS")])


_BARREL = """
PROFILES AS (SELECT DISTINCT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 60 AS STRING)) AS file, CASE WHEN p_partkey % 11 = 0 THEN 'default' ELSE concat('S', CAST(p_partkey % 11 AS STRING)) END AS symbol, concat('id', CAST(p_partkey % 660 AS STRING)) AS profile_id FROM part WHERE p_partkey % 60 % 4 = 0),
NAMED AS (SELECT DISTINCT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 60 AS STRING)) AS file, concat('S', CAST(p_partkey % 11 AS STRING)) AS exported, concat('f', CAST((p_partkey * 7 + 1) % 60 AS STRING)) AS target, CASE WHEN p_partkey % 11 % 5 = 0 THEN 'default' ELSE concat('S', CAST(p_partkey % 11 AS STRING)) END AS local, '1' AS ord FROM part WHERE p_partkey % 60 % 4 = 1),
STARS AS (SELECT DISTINCT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('f', CAST(p_partkey % 60 AS STRING)) AS file, concat('f', CAST((p_partkey * 11 + 3) % 60 AS STRING)) AS target, '2' AS ord FROM part WHERE p_partkey % 60 % 4 > 1)
"""


def _barrel(spark, d, name: str) -> DataFrame:
    line = next(x for x in _BARREL.strip().splitlines() if x.startswith(name))
    return A.run(spark, d, line.split(" AS (", 1)[1].rstrip(",").removesuffix(")"))


@query(f"""
WITH RECURSIVE {_BARREL}, e AS (SELECT repo_id, file, exported, target, local FROM NAMED UNION ALL SELECT repo_id, file, NULL, target, NULL FROM STARS), k(repo_id, file, symbol, profile_id, r) AS (
  SELECT repo_id, file, symbol, profile_id, 0 FROM PROFILES
  UNION SELECT k.repo_id, e.file, coalesce(e.exported, k.symbol), k.profile_id, k.r + 1 FROM k JOIN e ON e.repo_id = k.repo_id AND e.target = k.file AND (e.local = k.symbol OR e.local IS NULL AND k.symbol <> 'default') WHERE k.r < 5
) SELECT repo_id, file, symbol, arg_min(profile_id, r) AS profile_id FROM k GROUP BY 1, 2, 3""")
def c4_barrel_aliases(spark, d):
    return closures.alias_closure(*[_barrel(spark, d, x) for x in ("PROFILES", "NAMED", "STARS")])


# --- routes

ENTRIES = """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo_id, concat('/', CAST(p_partkey % 23 AS STRING)) AS path, CASE WHEN p_partkey % 5 > 0 THEN concat('f', CAST(p_partkey % 50 AS STRING)) END AS page, p_partkey AS ord,
       CASE p_partkey % 4 WHEN 0 THEN 'page-not-imported:Home' WHEN 1 THEN 'no-jsx-candidate-resolved' END AS warning
FROM part
"""
EDGES = """
SELECT DISTINCT concat('r', CAST(l_partkey % 3 AS STRING)) AS repo_id, concat('F', CAST(l_partkey % 50 AS STRING)) AS file, CASE WHEN l_suppkey % 4 > 0 THEN 'in-repo' ELSE 'external' END AS kind, concat('F', CAST((l_partkey % 50 * 3 + 1) % 200 AS STRING)) AS target FROM lineitem
"""
SITES = "SELECT DISTINCT concat('r', CAST(s_suppkey % 4 AS STRING)) AS repo_id, concat('site', CAST(s_suppkey % 6 AS STRING)) AS file FROM supplier"
_EDGE_SQL = f"SELECT DISTINCT repo_id, lower(file) AS src, lower(target) AS dst FROM ({EDGES}) e WHERE kind = 'in-repo'"


@query(_EDGE_SQL)
def t6_import_edges(spark, d):
    return routes.import_edges(A.run(spark, d, EDGES))


@query(f"WITH RECURSIVE g AS ({_EDGE_SQL}), n AS (SELECT repo_id, path, arg_max(coalesce(page, ''), ord) AS page FROM ({ENTRIES}) x GROUP BY 1, 2), w(repo_id, path, file, hops) AS (SELECT repo_id, path, page, 0 FROM n WHERE page <> '' UNION SELECT w.repo_id, w.path, dst, hops + 1 FROM w JOIN g ON g.repo_id = w.repo_id AND src = file WHERE hops < 3) SELECT repo_id, path, file FROM w UNION SELECT n.repo_id, path, s.file FROM n JOIN ({SITES}) s USING (repo_id)")
def t9_route_files(spark, d):
    """Reachable files (T7, at most three edges here), of the last entry of a path (T8), and router files under every path (T9)."""
    return routes.route_files(A.run(spark, d, ENTRIES), routes.import_edges(A.run(spark, d, EDGES)), A.run(spark, d, SITES), 3)


@query(f"WITH b AS (SELECT DISTINCT repo_id, page AS file, path FROM ({ENTRIES}) x WHERE page IS NOT NULL), f AS (SELECT DISTINCT repo_id, file FROM ({BINDING}) y) SELECT f.repo_id, f.file, CASE count(path) WHEN 0 THEN 'unmapped' WHEN 1 THEN 'bound' ELSE 'shared' END AS kind FROM f LEFT JOIN b USING (repo_id, file) WHERE f.repo_id IN (SELECT repo_id FROM b) GROUP BY 1, 2")
def t11_unsupported_repos(spark, d):
    """Repos without routes have no bindings at all."""
    bound = A.run(spark, d, ENTRIES).where("page IS NOT NULL").select("repo_id", F.col("page").alias("file"), "path")
    return routes.bind_files(A.run(spark, d, BINDING).select("repo_id", "file").distinct(), bound).select("repo_id", "file", "route.kind")


@query(f"SELECT repo_id, 'route-resolution-warning' AS code, warning AS message, split_part(warning, ':', 1) AS sub_code, count(*) AS n FROM ({ENTRIES}) x WHERE warning IS NOT NULL GROUP BY ALL")
def t12_route_warnings(spark, d):
    return routes.warning_rows(A.run(spark, d, ENTRIES)).groupBy("repo_id", "code", "message", "sub_code").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_regionkey > 2 ELSE CASE n_nationkey % 2 WHEN 0 THEN FALSE ELSE TRUE END END AS enabled FROM nation")
def t13_enabled(spark, d):
    own, shared = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey") > 2), F.when(F.col("n_nationkey") % 2 == 0, F.lit(False))
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", routes.enabled(own, shared).alias("enabled"))


# --- extractors, over sources built by rule

_SOURCE = r"""import React from 'react';
import {{ Button as B{k}, Modal }} from '@ds/{k}';
import * as All from './all{k}';
import {{ Z as Y{k} }} from './z'; // later {{ names }}
export function Card{p}({{ a, b{k}, ...rest }}) {{
  if (a) /it's <b>/.test(a);
  return <div><B{k} className="x"/><All.Item/>{{a && <span key='1'/>}}</div>;
}}
export const Plain = () => <><Modal/></>;
export default function () {{ return <B{k}><i/></B{k}>; }}
export {{ Q as R{k} }} from './q';
export * from './star{k}';
export const lazy{k} = React.lazy(() => import('./lazy'));
"""


def _sources(spark, d) -> DataFrame:
    text = F.lit(_SOURCE.replace("{{", "\x01").replace("}}", "\x02"))
    for mark, value in (("{k}", (F.col("p_partkey") % 9).cast("string")), ("{p}", F.col("p_partkey").cast("string")), ("\x01", F.lit("{")), ("\x02", F.lit("}"))):
        text = F.replace(text, F.lit(mark), value)
    parts = spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), "p_partkey")
    return parts.select(F.concat(F.lit("r"), F.col("p_partkey") % 5).alias("repo_id"), F.concat(F.lit("src/c"), "p_partkey", F.lit(".tsx")).alias("file"), text.alias("source"))


def _facts(spark, d, column: str) -> DataFrame:
    found = S.facts_of(_sources(spark, d), only=("file", "code", column))
    return found.where("code IS NULL").select("file", F.explode(column).alias("x"))


_PARTS = "WITH p AS (SELECT concat('src/c', CAST(p_partkey AS VARCHAR), '.tsx') AS file, CAST(p_partkey % 9 AS VARCHAR) AS k, CAST(p_partkey AS VARCHAR) AS p FROM part)"


@query(f"{_PARTS} SELECT file, v.* FROM p, LATERAL (VALUES ('React', 'react', NULL, FALSE), ('B' || k, '@ds/' || k, 'Button', FALSE), ('Modal', '@ds/' || k, 'Modal', FALSE), ('All', './all' || k, '*', TRUE), ('Y' || k, './z', 'Z', FALSE)) v(local, source, imported, is_namespace)")
def x1_import_bindings(spark, d):
    return _facts(spark, d, "bindings").select("file", "x.local", "x.source", "x.imported", "x.is_namespace")


@query(f"{_PARTS} SELECT file, v.* FROM p, LATERAL (VALUES ('div', 'div', 7, TRUE), ('B' || k, 'B' || k, 7, FALSE), ('All.Item', 'All', 7, FALSE), ('span', 'span', 7, TRUE), ('Modal', 'Modal', 9, FALSE), ('B' || k, 'B' || k, 10, FALSE), ('i', 'i', 10, TRUE)) v(tag, base, line, native)")
def x2_jsx_elements(spark, d):
    """Elements (X2), their names (X3) and the test for native tags (X4)."""
    from ..functions import expressions as X

    return _facts(spark, d, "elements").select("file", "x.tag", X.base_name(F.col("x.tag")).alias("base"), "x.line", X.is_native_tag(F.col("x.tag")).alias("native"))


@query(f"{_PARTS} SELECT file, v.* FROM p, LATERAL (VALUES ('Card' || p, 'a,b' || k, 4, 'div,span', 'B' || k, FALSE), ('Plain', '', 1, '', '', FALSE), ('default', '', 2, 'i', '', FALSE)) v(symbol, props, elements, html, customized, styled) UNION ALL SELECT file, 'lazy' || k, '', 0, '', '', FALSE FROM p WHERE FALSE")
def x5_profiles(spark, d):
    """Exported components (X5, X6) with their props (X10), element counts and tags (X7), customised tags (X8) and styled flag (X9)."""
    x = _facts(spark, d, "profiles")
    join = lambda c: F.array_join(F.array_sort(f"x.{c}"), ",")
    return x.select("file", "x.symbol", join("prop_names").alias("props"), F.col("x.jsx_element_count").alias("elements"), join("html_tags").alias("html"), join("customized").alias("customized"), F.col("x.uses_styled").alias("styled"))


@query(f"{_PARTS} SELECT file, v.* FROM p, LATERAL (VALUES ('react'), ('@ds/' || k), ('./all' || k), ('./z'), ('./q'), ('./star' || k), ('./lazy')) v(source)")
def x15_module_references(spark, d):
    return _facts(spark, d, "references").select("file", F.col("x").alias("source"))


_ROUTER = {
    "src/router.tsx": "import {{ createBrowserRouter }} from 'react-router-dom';\nimport {{ Guard }} from 'guard';\nimport {{ Page{k} }} from './pages';\nimport {{ PATHS }} from './paths';\nexport const router = createBrowserRouter([{{ path: PATHS.home, element: <Guard><Page{k}/></Guard>, children: [{{ path: 'b', Component: Page{k} }}, {{ index: true }}, {{ path: '/abs', lazy: () => import('./lazy') }}, {{ path: 'gone', element: <Missing/> }}] }}]);",
    "src/paths.ts": "export const PATHS = {{ home: '/a{k}' }} as const;",
    "src/pages.ts": "export {{ Home{k} as Page{k} }} from './b1';",
    "src/b1.ts": "export * from './b2';",
    "src/b2.ts": "export {{ Deep as Home{k} }} from './deep';",
    "src/deep.tsx": "export const Deep = () => <p/>;",
    "src/lazy.tsx": "export default function Lazy() {{ return <p/>; }}",
}


@query("SELECT concat('r', CAST(n_nationkey AS VARCHAR)) AS repo_id, v.* FROM nation, LATERAL (VALUES ('/a' || n_nationkey, 'src/deep.tsx', 'Deep', NULL), ('/a' || n_nationkey || '/b', 'src/deep.tsx', 'Deep', NULL), ('/abs', 'src/lazy.tsx', 'default', NULL), ('/a' || n_nationkey || '/gone', NULL, NULL, 'page-not-imported')) v(path, page, symbol, warning)")
def x17_route_entries(spark, d):
    """Router arrays (X16, X17), their tree (T2), constants (T3), page specs (T4), pages (T5, J2) and what defines them (C5)."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    files = F.array(*[F.struct(F.lit(name).alias("file"), F.replace(F.lit(text.replace("{{", "{").replace("}}", "}")), F.lit("{k}"), F.col("n_nationkey").cast("string")).alias("source")) for name, text in _ROUTER.items()])
    sources = nation.select(F.concat(F.lit("r"), "n_nationkey").alias("repo_id"), F.explode(files).alias("x")).select("repo_id", "x.*")
    facts = checkpoint(S.facts_of(sources))
    configs = spark.createDataFrame([], "repo_id string, folder string, tsconfig string")
    resolved = checkpoint(S.resolve_modules(facts, sources.select("repo_id", F.col("file").alias("path")), configs))
    found = S.route_entries(facts, resolved)
    return found.select("repo_id", "path", "page", "symbol", F.substring_index("warning", ":", 1).alias("warning"))


# --- recommendations as a whole

_OWN = f"""
WITH u AS ({A.USAGE}), s AS ({A.SHADOW}), r AS (SELECT repo_id, coalesce(CAST(count(*) FILTER (bucket = 'adoption') AS DOUBLE) / nullif(count(*) FILTER (bucket IN ('adoption', 'shadow')), 0), 0) AS value FROM u GROUP BY 1),
c AS (SELECT ds_package AS package, count(DISTINCT repo_id) AS repos_using FROM u WHERE category = 'ds' GROUP BY 1),
lows AS (SELECT *, row_number() OVER (ORDER BY value, repo_id) AS k FROM r WHERE value < 0.5), few AS (SELECT *, row_number() OVER (ORDER BY repos_using, package) AS k FROM c WHERE repos_using < 100),
v AS (
  SELECT 2 AS kn, 'outreach' AS kind, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS priority, 'Outreach: ' || count(*) || CASE WHEN count(*) = 1 THEN ' repo' ELSE ' repos' END || ' with adoption < 50%' AS title FROM lows HAVING count(*) > 0
  UNION ALL SELECT 3, 'promote-package', 'low', 'Promote ' || count(*) || CASE WHEN count(*) = 1 THEN ' package' ELSE ' packages' END FROM few HAVING count(*) > 0
)
SELECT row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, kn) AS position, kind, priority, title FROM v
"""


@query(_OWN)
def o6_priority_order(spark, d):
    """The list in order of priority and kind, here without groups."""
    from ..operators import metrics

    u = A.usage(spark, d)
    groups = metrics.shadow_by_component(A.shadow(spark, d)).where("repos_count < 0")
    found = recommend.recommendations(groups, metrics.per_repo_adoption(u), metrics.coverage(u), 1000, Thresholds(outreach_max=0.5))
    return found.select(F.col("position").cast("long").alias("position"), "kind", "priority", "title")
