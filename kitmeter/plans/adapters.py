"""Projections of the driver's tables to the dataset's schemas.

Each adapter is one SQL text in the dialect that Spark and DuckDB share, so the
queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = """
SELECT concat('repo-', CAST(l_suppkey AS STRING)) AS repo_id,
       concat('src/', CASE WHEN l_partkey % 5 = 0 THEN 'shared/ui/' ELSE '' END, 'f', CAST(l_orderkey % 97 AS STRING), '.tsx') AS file_path,
       CAST(l_linenumber AS INT) AS line, CAST(l_quantity AS INT) AS col, p_type AS component_name,
       CASE l_returnflag WHEN 'N' THEN 'ds' WHEN 'R' THEN 'local' ELSE CASE l_linestatus WHEN 'F' THEN 'html-native' ELSE 'third-party' END END AS category,
       CASE l_returnflag WHEN 'N' THEN 'adoption' WHEN 'R' THEN 'shadow' ELSE 'neither' END AS bucket,
       CASE WHEN l_returnflag <> 'R' THEN NULL WHEN l_quantity >= 40 THEN 'confirmed' WHEN l_quantity >= 20 THEN 'likely' ELSE 'possible' END AS shadow_level,
       CASE l_returnflag WHEN 'N' THEN 'direct-ds' WHEN 'R' THEN 'parallel-local-ui' ELSE 'utility-heuristic' END AS classification_source,
       CASE WHEN l_returnflag = 'N' THEN p_brand END AS ds_package,
       CASE l_orderkey % 97 % 4 WHEN 0 THEN 'unmapped' WHEN 1 THEN 'bound' WHEN 2 THEN 'shared' ELSE 'unsupported' END AS route_kind,
       CASE WHEN l_orderkey % 97 % 4 = 1 THEN concat('/r', CAST(l_orderkey % 97 % 8 AS STRING)) END AS route_path,
       CASE WHEN l_orderkey % 97 % 4 = 2 THEN concat('/a', CAST(l_orderkey % 97 % 3 AS STRING), ',/b') END AS route_paths,
       p_size AS p_size, p_name AS p_name, l_partkey AS l_partkey
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

SHADOW = f"""
SELECT repo_id, file_path, component_name, CAST(min(p_size) % 25 AS INT) AS jsx_element_count, concat('p', CAST(min(p_size) % 3 AS STRING)) AS prop,
       count(*) AS usage_count, CAST(1 AS BIGINT) AS files_used_in, min(shadow_level) AS shadow_level
FROM ({USAGE}) u WHERE bucket = 'shadow' GROUP BY repo_id, file_path, component_name
"""

PROFILE = """
SELECT concat('repo-', CAST(p_partkey % 20 AS STRING)) AS repo_id,
       concat('src/', CASE WHEN p_partkey % 4 = 0 THEN 'components/UI/' WHEN p_partkey % 4 = 1 THEN 'kit/' WHEN p_partkey % 4 = 2 THEN 'features/cart/' ELSE 'pages/' END, 'C', CAST(p_partkey AS STRING), '.tsx') AS file_path,
       CASE p_partkey % 11 WHEN 0 THEN 'Button' WHEN 1 THEN 'AuthProvider' WHEN 2 THEN 'UserQuery' WHEN 3 THEN 'AppShell' WHEN 4 THEN 'Modal' WHEN 5 THEN 'ModalContainer' WHEN 6 THEN 'useThing' WHEN 7 THEN 'Card' WHEN 8 THEN 'Widget' WHEN 9 THEN 'ThemeContext' ELSE 'Container' END AS component_name,
       CAST(p_size % 25 AS INT) AS jsx_element_count,
       p_brand LIKE '%1' AS has_ds_import, p_brand LIKE '%2' OR p_size % 7 = 0 AS customizes_ds, p_size % 11 = 0 AS wraps_ds_with_styled, p_size % 5 = 0 AS uses_styled,
       CAST(p_partkey % 4 AS BIGINT) AS files_used_in, p_partkey AS profile_id
FROM part
"""

EDGE = """
SELECT DISTINCT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, l_partkey % 97 AS src, (l_partkey * 31 + l_linenumber) % 97 AS dst FROM lineitem
"""

ROUTE_USAGE = """
SELECT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo_id, concat('f', CAST(l_partkey % 199 AS STRING)) AS file, o_orderpriority AS path
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

UNRESOLVED = """
SELECT concat('repo-', CAST(user_id % 10 AS STRING)) AS repo_id, event_type, event_id, concat('src/e', CAST(event_id % 50 AS STRING), '.tsx') AS file_path FROM events
"""

PENDING = """
SELECT concat('repo-', CAST(l_suppkey AS STRING)) AS repo_id, concat('d', CAST(l_partkey % 300 AS STRING)) AS def_file, concat('S', CAST(l_linenumber AS STRING)) AS symbol,
       concat('i', CAST(l_orderkey % 211 AS STRING)) AS importer, concat('src/x', CAST(l_orderkey % 211 AS STRING)) AS file_path, l_orderkey AS file_ord, l_linenumber * 1000000 + l_partkey AS site_ord, l_quantity AS quantity
FROM lineitem
"""


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter over the tables it names."""
    tables = [t for t in ("lineitem", "part", "orders", "events", "pages", "nation", "region", "customer", "supplier") if f" {t} " in f" {' '.join(sql.split())} "]
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = " ".join(f"{{{t}}}" if w == t else w for w in sql.split())
    return spark.sql(sql, **named)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.struct(F.col("route_kind").alias("kind"), F.col("route_path").alias("path"), F.split("route_paths", ",").alias("paths"))
    return run(spark, sf_dir, USAGE).withColumn("route", route).drop("route_kind", "route_path", "route_paths")


def shadow(spark: SparkSession, sf_dir: str, sql: str = SHADOW) -> DataFrame:
    return run(spark, sf_dir, sql).withColumn("prop_names", F.array("prop")).withColumn("signals", F.array(F.lit("substantial-markup")))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, UNRESOLVED)
