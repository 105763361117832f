"""Registered queries of the analytics core, each with its SQL where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import closures, counters, invariants, joins, metrics, recommend, routes, rules, tables
from ..schema import SHADOW, UNRESOLVED, USAGE
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_U = f"WITH u AS ({A.USAGE})"
_US = f"{_U}, s AS ({A.SHADOW})"
_ADOPT = "count(*) FILTER (bucket = 'adoption') AS adoption, count(*) FILTER (bucket = 'shadow') AS shadow, coalesce(CAST(count(*) FILTER (bucket = 'adoption') AS DOUBLE) / nullif(count(*) FILTER (bucket IN ('adoption', 'shadow')), 0), 0) AS value"
_BUCKET = "CASE WHEN jsx_element_count <= 2 THEN '0-2' WHEN jsx_element_count <= 4 THEN '3-4' WHEN jsx_element_count <= 9 THEN '5-9' WHEN jsx_element_count <= 19 THEN '10-19' ELSE '20+' END"
_KEY = f"substr(sha256(concat_ws('|', component_name, prop, {_BUCKET})), 1, 16)"
_RANK = "CASE shadow_level WHEN 'confirmed' THEN 3 WHEN 'likely' THEN 2 ELSE 1 END"
_GROUPS = f"{_US}, g AS (SELECT group_key, component_name, count(DISTINCT repo_id) AS repos_count, CAST(sum(usage_count) AS BIGINT) AS total_usages, count(DISTINCT repo_id || file_path) AS implementations, CASE max({_RANK}) WHEN 3 THEN 'confirmed' WHEN 2 THEN 'likely' ELSE 'possible' END AS level FROM (SELECT *, {_KEY} AS group_key FROM s) GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- metrics


@query(f"{_U} SELECT {_ADOPT}, 'adoption / (adoption + shadow)' AS formula FROM u")
def m_a_global_adoption(spark, d):
    return metrics.global_adoption(A.usage(spark, d))


@query(f"{_U} SELECT repo_id, {_ADOPT} FROM u GROUP BY repo_id")
def m_b_per_repo_adoption(spark, d):
    return metrics.per_repo_adoption(A.usage(spark, d))


@query(f"{_GROUPS} SELECT * FROM g")
def m_c1_shadow_by_component(spark, d):
    return metrics.shadow_by_component(A.shadow(spark, d)).withColumn("implementations", F.size("implementations").cast("long"))


@query(f"{_US} SELECT s.repo_id, s.file_path, component_name, shadow_level, 'substantial-markup' AS signals, usage_count, files_used_in, coalesce(route_kind, 'unsupported') AS route_kind, route_path FROM s LEFT JOIN (SELECT DISTINCT repo_id, file_path, route_kind, route_path FROM u) r USING (repo_id, file_path)")
def m_c2_shadow_by_file(spark, d):
    return metrics.shadow_by_file(A.shadow(spark, d), A.usage(spark, d)).withColumn("signals", F.array_join("signals", ","))


@query(f"{_U} SELECT ds_package AS package, count(DISTINCT repo_id) AS repos_using, count(*) AS instances FROM u WHERE category = 'ds' GROUP BY 1")
def m_d_coverage(spark, d):
    return metrics.coverage(A.usage(spark, d))


@query(f"{_U} SELECT component_name, ds_package AS package, count(DISTINCT repo_id) AS repos_using, count(*) AS instances, count(*) FILTER (bucket = 'adoption') AS adoption, count(*) FILTER (bucket = 'shadow') AS shadow FROM u WHERE category = 'ds' GROUP BY 1, 2")
def m_d_component_usage(spark, d):
    return metrics.component_usage(A.usage(spark, d))


@query(f"{_U} SELECT repo_id, route_path AS path, {_ADOPT} FROM u WHERE route_kind = 'bound' GROUP BY 1, 2")
def m_e_per_route_adoption(spark, d):
    return metrics.per_route_adoption(A.usage(spark, d))


@query(f"{_U} SELECT DISTINCT repo_id, file_path, component_name, bucket, route_paths AS paths FROM u WHERE route_kind = 'shared'")
def m_s_shared_components(spark, d):
    return metrics.shared_components(A.usage(spark, d)).withColumn("paths", F.array_join("paths", ","))


@query(f"{_U} SELECT count(*) FILTER (bucket = 'adoption') AS adoption, count(*) FILTER (bucket = 'shadow') AS shadow, count(*) FILTER (bucket = 'neither') AS neither FROM u")
def m_n_bucket_distribution(spark, d):
    return metrics.bucket_distribution(A.usage(spark, d))


_RATES = f"WITH e AS ({A.UNRESOLVED}), c AS (SELECT repo_id, count(*) FILTER (event_type <> 'error') AS usages, count(*) FILTER (event_type = 'error') AS unresolved FROM e GROUP BY repo_id)"


def _rates(spark, d):
    e = A.unresolved(spark, d)
    return metrics.unresolved_rate(e.where("event_type <> 'error'"), e.where("event_type = 'error'"))


@query(f"{_RATES} SELECT repo_id, usages, unresolved, CAST(unresolved AS DOUBLE) / (usages + unresolved) AS rate FROM c")
def m_u_unresolved_rate(spark, d):
    return _rates(spark, d)


@query(f"{_RATES} SELECT repo_id, 'unresolved-dynamic-rate-exceeded' AS code, format('unresolved-dynamic rate {{:.2f}}% exceeds threshold 5.00%', 100 * CAST(unresolved AS DOUBLE) / (usages + unresolved)) AS message FROM c WHERE CAST(unresolved AS DOUBLE) / (usages + unresolved) > 0.05")
def m_u_rate_warnings(spark, d):
    return metrics.rate_warnings(_rates(spark, d))


@query(f"{_US}, e AS ({A.UNRESOLVED}), f AS (SELECT repo_id, file_path FROM u UNION SELECT repo_id, file_path FROM s UNION SELECT repo_id, file_path FROM e) SELECT count(DISTINCT repo_id) AS repos_scanned, count(*) AS files_scanned FROM f")
def m_m_meta(spark, d):
    return metrics.meta(A.usage(spark, d), A.shadow(spark, d), A.unresolved(spark, d))


@query(f"{_US} SELECT repo_id, file_path, component_name, {_KEY} AS group_key FROM s")
def m_g_group_key(spark, d):
    return metrics.with_group_key(A.shadow(spark, d)).select("repo_id", "file_path", "component_name", "group_key")


@query(f"{_GROUPS} SELECT (SELECT avg(value) FROM (SELECT repo_id, {_ADOPT} FROM u GROUP BY 1)) AS mean_adoption, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE level = 'confirmed') AS confirmed, (SELECT count(DISTINCT ds_package) FROM u) AS packages")
def m_v_scalars(spark, d):
    u = A.usage(spark, d)
    return metrics.scalars(metrics.per_repo_adoption(u), metrics.shadow_by_component(A.shadow(spark, d)), metrics.coverage(u)).withColumn("mean_adoption", F.round("mean_adoption", 12))


_SQL["m_v_scalars"] = _SQL["m_v_scalars"].replace("(SELECT avg(value) FROM", "(SELECT round(avg(value), 12) FROM")


# --- rules

_NEITHER = "CASE WHEN regexp_matches(component_name, '(Provider|Context|Gate)$') THEN 'provider-context' WHEN regexp_matches(component_name, '^use[A-Z]') THEN 'hook-like' WHEN regexp_matches(component_name, '(Query|Mutation|Fetcher|Loader|Data)$') AND jsx_element_count <= 2 THEN 'data-component' WHEN regexp_matches(component_name, '(Layout|Page|Template|Shell|Scaffold)$') AND jsx_element_count <= 3 THEN 'layout-wrapper' WHEN regexp_matches(component_name, '(Container|Wrapper)$') THEN 'business-container' END"
_RULES = f"""
WITH p AS (SELECT *, {_NEITHER} AS neither_code,
    customizes_ds OR wraps_ds_with_styled AS s1, uses_styled AND NOT has_ds_import AS s2, component_name IN ('Button', 'Modal', 'Card', 'Container') AS s3,
    jsx_element_count >= 5 AS s4, files_used_in >= 2 AS s5, regexp_matches(lower(file_path), '(^|/)(ui|kit)(/|$)') AS s6 FROM ({A.PROFILE}) x),
q AS (SELECT *, concat_ws(',', CASE WHEN s1 THEN 'wraps-with-customization' END, CASE WHEN s2 THEN 'standalone-styled' END, CASE WHEN s3 THEN 'primitive-like-name' END, CASE WHEN s4 THEN 'substantial-markup' END, CASE WHEN s5 THEN 'reusable-local' END, CASE WHEN s6 THEN 'parallel-layer' END) AS sig,
    CASE WHEN neither_code IS NOT NULL THEN 1 WHEN has_ds_import AND s1 THEN 2 WHEN has_ds_import AND s4 THEN 3 WHEN has_ds_import THEN 4 WHEN s1 OR s2 OR s3 OR s4 OR s5 OR s6 THEN 5 ELSE 6 END AS r FROM p)
"""


@query(_RULES + "SELECT profile_id, CASE WHEN r IN (2, 3, 5) THEN 'shadow' WHEN r = 4 THEN 'adoption' ELSE 'neither' END AS bucket, CASE WHEN r IN (2, 3) THEN 'wraps-with-customization' WHEN r = 4 THEN 'ds-composition' WHEN r = 5 THEN 'parallel-local-ui' ELSE 'utility-heuristic' END AS classification_source, CASE WHEN r IN (2, 3) THEN 'possible' WHEN r = 5 THEN CASE WHEN s3 AND s4 THEN 'confirmed' WHEN s5 THEN 'likely' ELSE 'possible' END END AS shadow_level, CASE WHEN r IN (2, 3, 4, 5) THEN sig ELSE '' END AS signals FROM q")
def r_stage_b(spark, d):
    out = rules.stage_b(A.run(spark, d, A.PROFILE))
    return out.select("profile_id", "bucket", "classification_source", "shadow_level", F.array_join("signals", ",").alias("signals"))


@query(_RULES + "SELECT profile_id, neither_code FROM q")
def r1_neither_code(spark, d):
    return A.run(spark, d, A.PROFILE).select("profile_id", rules.neither_code(F.col("component_name"), F.col("jsx_element_count")).alias("neither_code"))


@query(_RULES + "SELECT profile_id, sig AS signals, s6 AS parallel_layer FROM q")
def r2_signals(spark, d):
    return A.run(spark, d, A.PROFILE).select("profile_id", F.array_join(rules.signals(), ",").alias("signals"), X.parallel_layer(F.col("file_path")).alias("parallel_layer"))


_STAGE_A_IN = """
SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS pk,
       CASE l_partkey % 4 WHEN 0 THEN 'div' WHEN 1 THEN 'Form.Item' WHEN 2 THEN '_Private' ELSE 'Card' END AS tag,
       CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN './local' WHEN 2 THEN '@ds/button' WHEN 3 THEN 'react' ELSE '@/alias' END AS source,
       CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'in-repo' ELSE 'unresolved' END WHEN 2 THEN 'external' WHEN 3 THEN 'external' ELSE 'in-repo' END AS resolved_kind,
       l_suppkey % 5 = 2 AS is_ds_package,
       CASE WHEN l_suppkey % 5 = 4 AND l_linenumber % 3 = 0 THEN 'kit' END AS lib_id, l_quantity > 25 AS lib_backed
FROM lineitem
"""


@query(f"""
WITH x AS ({_STAGE_A_IN}), y AS (SELECT *, CASE WHEN tag = 'div' THEN 1 WHEN source IS NOT NULL AND resolved_kind = 'external' AND is_ds_package THEN 2 WHEN lib_id IS NOT NULL AND lib_backed THEN 3 WHEN lib_id IS NOT NULL THEN 4 WHEN resolved_kind = 'in-repo' THEN 5 WHEN resolved_kind = 'unresolved' AND source LIKE './%' THEN 6 WHEN source IS NOT NULL THEN 7 ELSE 8 END AS r FROM x)
SELECT CASE WHEN r = 1 THEN 'html-native' WHEN r = 2 THEN 'ds' WHEN r IN (3, 4) THEN 'local-library' WHEN r = 7 THEN 'third-party' ELSE 'local' END AS category, CASE WHEN r IN (1, 7) THEN 'neither' WHEN r IN (2, 3) THEN 'adoption' END AS bucket, r IN (4, 5, 6, 8) AS pending, count(*) AS n, CAST(sum(pk) AS BIGINT) AS parts FROM y GROUP BY ALL""")
def r_stage_a(spark, d):
    out = rules.stage_a(A.run(spark, d, _STAGE_A_IN))
    return out.groupBy("category", "bucket", "pending").agg(F.count("*").alias("n"), F.sum("pk").alias("parts"))


# --- invariants


#: Usages of which some break each rule.
_BAD = f"SELECT repo_id, file_path, CASE WHEN line = 7 AND col < 10 THEN 'odd' ELSE bucket END AS bucket, CASE WHEN col = 3 THEN 'likely' WHEN col = 45 THEN NULL ELSE shadow_level END AS shadow_level, category, CASE WHEN line = 2 AND col > 40 THEN 'guess' WHEN line <> 1 THEN classification_source END AS classification_source, CASE WHEN col <> 11 THEN ds_package END AS ds_package, CASE WHEN route_kind = 'shared' AND line = 3 THEN 'lost' WHEN line <> 4 THEN route_kind END AS route_kind, route_path FROM ({A.USAGE}) x"
_B = f"WITH u AS ({_BAD})"


def _bad(spark, d) -> DataFrame:
    route = F.struct(F.col("route_kind").alias("kind"), F.col("route_path").alias("path"), F.lit(None).cast("array<string>").alias("paths"))
    return A.run(spark, d, _BAD).withColumn("route", route).drop("route_kind", "route_path")


@query(f"{_B} SELECT 'level-iff-shadow' AS code, count(*) AS count FROM u WHERE (shadow_level IS NOT NULL) <> (bucket = 'shadow') UNION ALL SELECT 'invalid-bucket', count(*) FROM u WHERE bucket NOT IN ('adoption', 'shadow', 'neither') UNION ALL SELECT 'unknown-source', count(*) FROM u WHERE classification_source IS NULL OR classification_source = 'guess' UNION ALL SELECT 'ds-package-missing', count(*) FROM u WHERE category = 'ds' AND ds_package IS NULL UNION ALL SELECT 'invalid-route', count(*) FROM u WHERE route_kind IS NULL OR route_kind = 'lost'")
def i_row_checks(spark, d):
    return invariants.row_checks(_bad(spark, d))


@query(f"{_B} SELECT 'dataset-completeness-shadow' AS code, abs((SELECT count(*) FROM u WHERE bucket = 'shadow') - (SELECT sum(usage_count) FROM ({A.SHADOW}) s)) AS count UNION ALL SELECT 'dataset-completeness-coverage', (SELECT count(*) FROM u WHERE category = 'ds' AND ds_package IS NULL)")
def i5_completeness(spark, d):
    u = _bad(spark, d)
    found = invariants.completeness(u, A.shadow(spark, d), metrics.coverage(u.where("ds_package IS NOT NULL")))
    return found.withColumn("count", F.col("count").cast("long"))


_SQL["i5_completeness"] = _SQL["i5_completeness"].replace("(SELECT sum(usage_count) FROM", "(SELECT CAST(sum(usage_count) AS BIGINT) FROM")


@query(f"{_U} SELECT 'per-route-bound-only' AS code, count(*) AS count FROM u WHERE route_kind = 'shared' AND bucket IN ('adoption', 'shadow')")
def i8_route_recompute(spark, d):
    """Against a route metric that counts shared usages too."""
    u = A.usage(spark, d)
    wider = u.withColumn("route", F.when(F.col("route.kind") == "shared", F.struct(F.lit("bound").alias("kind"), F.lit("/x").alias("path"), F.lit(None).cast("array<string>").alias("paths"))).otherwise(F.col("route")))
    return invariants.route_recompute(u, metrics.per_route_adoption(wider))


@query(f"{_U} SELECT 'mixed-schema-version' AS code, count(DISTINCT line % 3) - 1 AS count FROM u")
def i6_single_version(spark, d):
    return invariants.single_version(A.usage(spark, d).select(F.concat(F.lit("1."), F.col("line") % 3).alias("schema_version")))


#: The columns of a usage without its route, in order of names.
_HASHED = "bucket category classification_source col component_name ds_package file_path l_partkey line p_name p_size repo_id shadow_level".split()


def _digest_sql() -> str:
    text = " || '|' || ".join(f"'{c}=' || coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in _HASHED)
    limbs = " || '-' || ".join(f"CAST(sum(CAST(CAST('0x' || h[{16 * k + 1}:{16 * k + 16}] AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)" for k in range(4))
    return f"{_U}, z AS (SELECT sha256({text}) AS h FROM u) SELECT count(*) AS rows, {limbs} AS digest FROM z"


@query(_digest_sql())
def i9_content_hash(spark, d):
    """A digest of a bag of rows (I9) that parts add up to: here that of each repo, merged."""
    return invariants.merged_digest(invariants.digest_limbs(A.usage(spark, d).drop("route"), "repo_id"))


# --- recommendations and tables


@query(f"{_GROUPS} SELECT 'Add to the design system: ' || component_name AS title, CASE WHEN repos_count >= 10 OR level = 'confirmed' THEN 'high' WHEN level = 'likely' THEN 'medium' ELSE 'low' END AS priority, group_key AS evidence FROM g WHERE repos_count >= 5 ORDER BY repos_count * total_usages DESC, total_usages DESC, component_name, group_key LIMIT 5")
def o2_add_candidates(spark, d):
    return recommend.add_candidates(metrics.shadow_by_component(A.shadow(spark, d))).select("title", "priority", F.get("evidence", F.lit(0)).alias("evidence"))


@query(f"{_U}, r AS (SELECT repo_id, {_ADOPT} FROM u GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY value, repo_id) AS k FROM r WHERE value < 0.5) SELECT CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS priority, string_agg(repo_id, ',' ORDER BY k) AS evidence, 'Outreach: ' || count(*) || CASE WHEN count(*) = 1 THEN ' repo' ELSE ' repos' END || ' with adoption < 50%' AS title FROM l HAVING count(*) > 0")
def o3_outreach(spark, d):
    out = recommend.outreach(metrics.per_repo_adoption(A.usage(spark, d)), recommend.Thresholds(outreach_max=0.5))
    return out.select("priority", F.array_join("evidence", ",").alias("evidence"), "title")


@query(f"{_U}, c AS (SELECT ds_package AS package, count(DISTINCT repo_id) AS n FROM u WHERE category = 'ds' GROUP BY 1) SELECT 'low' AS priority, string_agg(package, ',' ORDER BY n, package) AS evidence FROM c WHERE n < 100 HAVING count(*) > 0")
def o4_promote(spark, d):
    return recommend.promote(metrics.coverage(A.usage(spark, d)), 1000).select("priority", F.array_join("evidence", ",").alias("evidence"))


_MILD = _GROUPS.replace(A.SHADOW, A.SHADOW.replace("min(shadow_level) AS shadow_level", "CASE WHEN min(p_size) % 9 = 0 THEN min(shadow_level) ELSE 'possible' END AS shadow_level"))


@query(f"{_MILD} SELECT 'Tune thresholds: ' || count(*) FILTER (level = 'possible') || ' possible vs ' || count(*) FILTER (level = 'confirmed') || ' confirmed' AS title FROM g HAVING count(*) FILTER (level = 'possible') > 3 * count(*) FILTER (level = 'confirmed')")
def o5_tune(spark, d):
    """Levels of most groups are lowered, so that there is something to tune."""
    s = A.shadow(spark, d, A.SHADOW.replace("min(shadow_level) AS shadow_level", "CASE WHEN min(p_size) % 9 = 0 THEN min(shadow_level) ELSE 'possible' END AS shadow_level"))
    return recommend.tune(metrics.shadow_by_component(s)).select("title")


@query()
def o6_recommendations(spark, d):
    u = A.usage(spark, d)
    return recommend.recommendations(metrics.shadow_by_component(A.shadow(spark, d)), metrics.per_repo_adoption(u), metrics.coverage(u), 100)


@query(f"{_GROUPS} SELECT group_key, component_name, total_usages, round(CAST(total_usages AS DOUBLE) / (SELECT max(total_usages) FROM g) * 100, 1) AS width FROM g ORDER BY total_usages DESC, component_name, group_key LIMIT 10")
def o7_pareto(spark, d):
    return tables.pareto(metrics.shadow_by_component(A.shadow(spark, d)))


@query(f"{_U} SELECT ds_package AS package, count(DISTINCT repo_id) AS repos_using, count(*) AS instances FROM u WHERE category = 'ds' GROUP BY 1 ORDER BY instances DESC, package LIMIT 3")
def o8_top_packages(spark, d):
    return tables.top_packages(metrics.coverage(A.usage(spark, d)))


@query(f"{_GROUPS} SELECT group_key, level, total_usages FROM g ORDER BY CASE level WHEN 'confirmed' THEN 3 WHEN 'likely' THEN 2 ELSE 1 END DESC, total_usages DESC, group_key OFFSET 10 LIMIT 10")
def o10_sorted_page(spark, d):
    g = metrics.shadow_by_component(A.shadow(spark, d)).select("group_key", "level", "total_usages")
    return tables.page(g, [*tables.table_sort(g, "level", True), F.desc("total_usages"), F.col("group_key")], 1, 10)


@query(f"{_U} SELECT bucket, count(*) AS count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM u) AS fraction FROM u GROUP BY bucket")
def o11_donut(spark, d):
    return tables.donut(metrics.bucket_distribution(A.usage(spark, d)))


@query(f"{_U} SELECT repo_id, CASE WHEN value >= 0.7 THEN 'high' WHEN value >= 0.4 THEN 'medium' WHEN value > 0 THEN 'low' ELSE 'none' END AS band FROM (SELECT repo_id, {_ADOPT} FROM u GROUP BY 1)")
def o12_bands(spark, d):
    return metrics.per_repo_adoption(A.usage(spark, d)).select("repo_id", tables.band(F.col("value")).alias("band"))


@query(f"{_U} SELECT repo_id, {_ADOPT} FROM u GROUP BY repo_id HAVING repo_id LIKE '%7%' OR CAST(count(*) FILTER (bucket = 'adoption') AS STRING) LIKE '%7%' OR CAST(count(*) FILTER (bucket = 'shadow') AS STRING) LIKE '%7%'")
def f4_text_filter(spark, d):
    return tables.text_filter(metrics.per_repo_adoption(A.usage(spark, d)), "7", ["repo_id", "adoption", "shadow"])


@query(f"{_U} SELECT component_name, ds_package AS package, count(*) AS instances, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM u WHERE category = 'ds') * 100, 1) AS share_pct FROM u WHERE category = 'ds' GROUP BY 1, 2")
def o_component_share(spark, d):
    return tables.component_share(A.usage(spark, d)).select("component_name", "package", "instances", "share_pct")


# --- counters


@query(f"WITH p AS ({A.PENDING}) SELECT repo_id, def_file, symbol, count(*) AS usage_count, count(DISTINCT importer) AS files_used_in FROM p GROUP BY 1, 2, 3")
def g1_key_counters(spark, d):
    return counters.key_counters(A.run(spark, d, A.PENDING))


_ALIAS = "SELECT DISTINCT repo_id, def_file, symbol, concat(repo_id, ':', CASE WHEN symbol IN ('S1', 'S2') THEN 'S1' ELSE symbol END, ':', substr(def_file, 1, 2)) AS profile_id FROM p WHERE symbol <> 'S7'"


@query(f"WITH p AS ({A.PENDING}), a AS ({_ALIAS}) SELECT profile_id, count(*) AS usage_count, count(DISTINCT importer) AS files_used_in FROM p JOIN a USING (repo_id, def_file, symbol) GROUP BY 1")
def g2_merged_counters(spark, d):
    p = A.run(spark, d, A.PENDING)
    merged = F.concat_ws(":", "repo_id", F.when(F.col("symbol").isin("S1", "S2"), "S1").otherwise(F.col("symbol")), F.substring("def_file", 1, 2))
    aliases = p.where("symbol <> 'S7'").select("repo_id", "def_file", "symbol", merged.alias("profile_id")).distinct()
    return counters.usage_counters(p, aliases)


@query(f"WITH p AS ({A.PENDING}) SELECT repo_id, def_file, symbol, count(*) AS usage_count, CAST(1 AS BIGINT) AS files_used_in, 'possible' AS shadow_level, arg_min(file_path, (file_ord, site_ord)) AS file_path FROM p GROUP BY 1, 2, 3")
def g3_synthetic_shadows(spark, d):
    p = A.run(spark, d, A.PENDING).withColumns({"component_name": F.lit("X"), "local_lib_id": F.lit("kit")})
    return counters.synthetic_shadows(p).drop("component_name", "local_lib_id")


# --- closures and routes


@query(f"WITH RECURSIVE e AS ({A.EDGE}), r(repo_id, root, node) AS (SELECT DISTINCT repo_id, src, src FROM e UNION SELECT r.repo_id, root, dst FROM r JOIN e ON r.repo_id = e.repo_id AND r.node = e.src) SELECT repo_id, root, node FROM r")
def t7_reachable(spark, d):
    e = A.run(spark, d, A.EDGE)
    return closures.reachable(e, e.select("repo_id", F.col("src").alias("root")).distinct(), 97).drop("hops")


_CHAIN = "SELECT DISTINCT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, l_partkey % 90 AS src, l_partkey % 90 + 1 AS dst FROM lineitem"


@query(f"WITH RECURSIVE e AS ({_CHAIN}), r(repo_id, root, node, hops) AS (SELECT DISTINCT repo_id, src, src, 0 FROM e UNION SELECT r.repo_id, root, dst, hops + 1 FROM r JOIN e ON r.repo_id = e.repo_id AND r.node = e.src WHERE hops < 20) SELECT repo_id, root, node, hops FROM r")
def t7_depth_limit(spark, d):
    """Chains longer than the limit of 20 edges."""
    e = A.run(spark, d, _CHAIN + " ")
    return closures.reachable(e, e.select("repo_id", F.col("src").alias("root")).distinct())


_ROUTE = f"WITH b AS (SELECT DISTINCT repo_id, file, path FROM ({A.ROUTE_USAGE}) z), f AS (SELECT DISTINCT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('f', CAST(l_partkey % 199 AS STRING)) AS file FROM lineitem)"


@query(f"{_ROUTE}, g AS (SELECT repo_id, file, count(*) AS n, string_agg(path, ',' ORDER BY path) AS p FROM b GROUP BY 1, 2) SELECT f.repo_id, f.file, CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'bound' ELSE 'shared' END AS kind, CASE WHEN n = 1 THEN p END AS path, CASE WHEN n > 1 THEN p END AS paths FROM f LEFT JOIN g USING (repo_id, file)")
def t10_bind_files(spark, d):
    b = A.run(spark, d, A.ROUTE_USAGE)
    files = A.run(spark, d, "SELECT DISTINCT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('f', CAST(l_partkey % 199 AS STRING)) AS file FROM lineitem ")
    return routes.bind_files(files, b).select("repo_id", "file", "route.kind", "route.path", F.array_join("route.paths", ",").alias("paths"))


@query("WITH x AS (SELECT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('/p', CAST(l_partkey % 40 AS STRING)) AS path, l_partkey AS page, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord FROM lineitem) SELECT repo_id, path, arg_max(page, ord) AS page FROM x GROUP BY 1, 2")
def t8_last_entry(spark, d):
    x = A.run(spark, d, "SELECT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('/p', CAST(l_partkey % 40 AS STRING)) AS path, l_partkey AS page, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord FROM lineitem ")
    return routes.last_entry(x).select("repo_id", "path", "page")


@query("WITH x AS (SELECT concat('/', split_part(url, '/', 4)) AS parent, split_part(split_part(url, '/', 5), '?', 1) AS child FROM pages) SELECT parent, child, CASE WHEN child = '' THEN CASE WHEN parent = '' THEN '/' ELSE parent END WHEN child LIKE '/%' THEN child ELSE regexp_replace(parent, '/$', '') || '/' || child END AS joined FROM x")
def t1_join_path(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    x = pages.select(F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("parent"), F.split_part(F.split_part("url", F.lit("/"), F.lit(5)), F.lit("?"), F.lit(1)).alias("child"))
    return x.select("parent", "child", X.join_path(F.col("parent"), F.col("child")).alias("joined"))


# --- extraction over pages and strings


@query("WITH t AS (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, lower(tag[1]) = tag[1] AS native, count(*) AS n FROM t GROUP BY 1, 2")
def x2_native_tags(spark, d):
    tags = spark.read.parquet(f"{d}/pages.parquet").select(F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag", X.is_native_tag(F.col("tag")).alias("native")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '@s/p' || page_id || '/x/y' WHEN 1 THEN 'pkg' || page_id || '/deep' ELSE '@scope' END AS s FROM pages) SELECT page_id, CASE WHEN regexp_extract(s, '^(@[^/]+/[^/]+|[^/]+)', 1) = '' THEN s ELSE regexp_extract(s, '^(@[^/]+/[^/]+|[^/]+)', 1) END AS package FROM x")
def x18_package_name(spark, d):
    s = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("@s/p"), "page_id", F.lit("/x/y"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("pkg"), "page_id", F.lit("/deep"))).otherwise("@scope")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.package_name(s).alias("package"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'n' || page_id ELSE coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/:]+)$', 1), '\\.git$', ''), ''), url) END AS repo_id FROM pages")
def p4_repo_id(spark, d):
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("n"), "page_id")).otherwise("")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.repo_id(name, F.col("url")).alias("repo_id"))


@query(f"WITH p AS ({A.PROFILE}) SELECT profile_id, array_to_string(string_split(file_path, '/')[1:-2], '/') AS segments, CASE WHEN file_path LIKE '%features/%' THEN 'cart' END AS feature FROM p")
def p3_path_hint(spark, d):
    p = A.run(spark, d, A.PROFILE)
    return p.select("profile_id", F.array_join(X.directory_segments(F.col("file_path")), "/").alias("segments"), X.feature(F.col("file_path")).alias("feature"))


@query(f"WITH p AS ({A.PROFILE}) SELECT profile_id, file_path FROM p WHERE (file_path LIKE 'src/kit/%' OR file_path LIKE 'src/pages/%') AND NOT regexp_matches(file_path, '/C1[^/]*\\.tsx$')")
def f1_globs(spark, d):
    p = A.run(spark, d, A.PROFILE)
    return p.where(X.matches_any(F.col("file_path"), ["src/{kit,pages}/**/*.tsx"]) & ~X.matches_any(F.col("file_path"), ["**/C1*.tsx"], True)).select("profile_id", "file_path")


# --- joins


@query("SELECT c_custkey, coalesce(n.n_name, 'none') AS ds_package, CASE WHEN n.n_name IS NOT NULL AND n.n_name <> r_name THEN r_name END AS canonicalized_via FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j4_canonical_package(spark, d):
    t = {x: spark.read.parquet(f"{d}/{x}.parquet") for x in ("customer", "nation", "region")}
    uses = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("package"), F.col("n_name").alias("imported"))
    exports = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("pkg"), F.col("n_name").alias("symbol"), F.col("n_name").alias("source_pkg"))
    return joins.canonical_package(uses, exports).select("c_custkey", "ds_package", "canonicalized_via")


@query("WITH s AS (SELECT 'r' || (s_suppkey % 3) AS repo_id, 'lib' || (s_suppkey % 9) AS lib_id, min(s_suppkey) AS k FROM supplier GROUP BY 1, 2), o AS (SELECT 'r' || (s_suppkey % 3) AS repo_id, 'lib' || (s_suppkey % 4) AS lib_id, -min(s_suppkey) AS k FROM supplier GROUP BY 1, 2) SELECT repo_id, lib_id, k, 0 AS scope FROM o UNION ALL SELECT repo_id, lib_id, k, 1 FROM s WHERE (repo_id, lib_id) NOT IN (SELECT repo_id, lib_id FROM o)")
def j11_override_libraries(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lib = lambda m, sign: s.groupBy(F.concat(F.lit("r"), F.col("s_suppkey") % 3).alias("repo_id"), F.concat(F.lit("lib"), F.col("s_suppkey") % m).alias("lib_id")).agg((sign * F.min("s_suppkey")).alias("k"))
    return joins.override_libraries(lib(9, 1), lib(4, -1))


# --- records


@query(f"{_US}, e AS ({A.UNRESOLVED}) SELECT 'usage' AS kind, count(*) AS n FROM u UNION ALL SELECT 'shadow-component', count(*) FROM s UNION ALL SELECT 'unresolved-dynamic', count(*) FROM e")
def f2_kind_counts(spark, d):
    kinds = {"usage": A.usage(spark, d), "shadow-component": A.shadow(spark, d), "unresolved-dynamic": A.unresolved(spark, d)}
    parts = [df.select(F.lit(k).alias("kind"), "repo_id", "file_path") for k, df in kinds.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_U} SELECT repo_id, file_path, line, col, component_name, bucket FROM u ORDER BY repo_id, file_path, line, col, component_name, bucket")
def o1_dataset_order(spark, d):
    u = A.usage(spark, d).select("repo_id", "file_path", "line", "col", "component_name", "bucket")
    return u.orderBy("repo_id", "file_path", "line", "col", "component_name", "bucket")


@query(f"{_U} SELECT repo_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(col) AS BIGINT) AS columns, count(ds_package) AS packages FROM u GROUP BY 1")
def s7_jsonl_round_trip(spark, d):
    from ..schema import USAGE
    from ..session import shared_folder
    from ..sources import records

    u = A.usage(spark, d)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in USAGE if f.name not in u.columns}
    path = shared_folder(spark, "jsonl")
    records.write_lines(records.usage_json(u.withColumns(missing)), path)
    back = records.read_jsonl(spark, path)["usage"]
    return back.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.sum("col").alias("columns"), F.count("ds_package").alias("packages"))


_KINDS = f"{_US}, e AS ({A.UNRESOLVED})"


@query(f"""{_KINDS} SELECT 'usage' AS kind, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM u UNION ALL SELECT 'shadow-component', count(*), NULL FROM s
UNION ALL SELECT 'unresolved-dynamic', count(*), NULL FROM e UNION ALL SELECT 'malformed', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), NULL""")
def u1_record_kinds(spark, d):
    """One dataset of all kinds of records (U1), read back as VARIANT; lines that are no records are rows of their own."""
    from ..sources import records

    cut = F.concat(F.lit('{"kind": "usage", "repoId": "'), "n_name")
    bad = spark.read.parquet(f"{d}/nation.parquet").select(cut.alias("value")).unionByName(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("value")))
    parts = [records.usage_json(_whole(A.usage(spark, d), USAGE)), _whole(A.shadow(spark, d), SHADOW).select(records.shadow_value().alias("value")), _whole(A.unresolved(spark, d), UNRESOLVED).select(records.unresolved_value().alias("value")), bad]
    found = records.variants(reduce(DataFrame.unionByName, parts))
    return found.groupBy(F.coalesce("kind", F.lit("malformed")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.try_variant_get("record", "$.line", "long")).alias("lines"))


def _whole(df, schema):
    """The columns of a schema, null where the adapter has none."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


@query(f"{_U} SELECT repo_id, count(*) FILTER (bucket = 'adoption') AS adoption, count(*) FILTER (bucket = 'shadow') AS shadow FROM u GROUP BY 1")
def s8_aggregates_round_trip(spark, d):
    """Aggregates as one nested document (S8), taken apart again by VARIANT: a row for each element."""
    from ..sources import records

    u = metrics.per_repo_adoption(A.usage(spark, d)).select(F.col("repo_id").alias("repoId"), "adoption", "shadow")
    # a document for each of 16 parts of the repos
    docs = u.groupBy(F.pmod(F.xxhash64("repoId"), F.lit(16)).alias("k")).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("repoId", "adoption", "shadow")).alias("perRepoAdoption")).alias("metrics"))).alias("value"))
    rows = records.elements(docs.select("value"), "$.metrics.perRepoAdoption", {"repo_id": ("$.repoId", "string"), "adoption": ("$.adoption", "long"), "shadow": ("$.shadow", "long")})
    return rows.select("repo_id", "adoption", "shadow")


from . import relations as _relations  # noqa: E402, F401  registers its queries here
from . import tracing as _tracing  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
