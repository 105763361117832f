"""Adoption metrics over usage and shadow component rows. Array-valued outputs are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

FORMULA = "adoption / (adoption + shadow)"


def _bucket(name: str) -> Column:
    return F.count_if(F.col("bucket") == name).cast("long")


def _adoption() -> list[Column]:
    a, s = _bucket("adoption"), _bucket("shadow")
    return [X.ratio(a, a + s).alias("value"), a.alias("adoption"), s.alias("shadow")]


def global_adoption(usage: DataFrame) -> DataFrame:
    return usage.agg(*_adoption()).withColumn("formula", F.lit(FORMULA))


def per_repo_adoption(usage: DataFrame) -> DataFrame:
    return usage.groupBy("repo_id").agg(*_adoption())


def bucket_distribution(usage: DataFrame) -> DataFrame:
    return usage.agg(*[_bucket(b).alias(b) for b in ("adoption", "shadow", "neither")])


def coverage(usage: DataFrame) -> DataFrame:
    return usage.where("category = 'ds'").groupBy(F.col("ds_package").alias("package")).agg(F.countDistinct("repo_id").alias("repos_using"), F.count("*").alias("instances"))


def component_usage(usage: DataFrame) -> DataFrame:
    return usage.where("category = 'ds'").groupBy("component_name", F.col("ds_package").alias("package")).agg(F.countDistinct("repo_id").alias("repos_using"), F.count("*").alias("instances"), _bucket("adoption").alias("adoption"), _bucket("shadow").alias("shadow"))


def per_route_adoption(usage: DataFrame) -> DataFrame:
    bound = usage.where(F.col("route.kind") == "bound")
    return bound.groupBy("repo_id", F.col("route.path").alias("path")).agg(*_adoption())


def shared_components(usage: DataFrame) -> DataFrame:
    shared = usage.where(F.col("route.kind") == "shared")
    return shared.select("repo_id", "file_path", "component_name", "bucket", F.sort_array("route.paths").alias("paths")).distinct()


def shadow_by_file(shadow: DataFrame, usage: DataFrame) -> DataFrame:
    """One row for each shadow component, with the route of its file; a file's route is one value."""
    routes = usage.groupBy("repo_id", "file_path").agg(F.min(F.struct("route.kind", "route.path", F.array_join("route.paths", ",").alias("paths"))).alias("r"))
    rows = shadow.join(routes, ["repo_id", "file_path"], "left")
    return rows.select("repo_id", "file_path", "component_name", "shadow_level", "signals", "usage_count", "files_used_in", F.coalesce("r.kind", F.lit("unsupported")).alias("route_kind"), F.col("r.path").alias("route_path"))


def with_group_key(shadow: DataFrame) -> DataFrame:
    return shadow.withColumn("group_key", X.group_key(F.col("component_name"), F.col("prop_names"), F.col("jsx_element_count")))


def shadow_by_component(shadow: DataFrame) -> DataFrame:
    """Groups of the same name, props and size; the level is that of the most severe member."""
    found = with_group_key(shadow).groupBy("group_key", "component_name").agg(
        F.countDistinct("repo_id").alias("repos_count"),
        F.sum("usage_count").alias("total_usages"),
        F.sort_array(F.collect_set(F.struct("repo_id", "file_path"))).alias("implementations"),
        F.max(X.level_rank(F.col("shadow_level"))).alias("__rank"),
    )
    return found.withColumn("level", X.level_of_rank(F.col("__rank"))).drop("__rank")


def unresolved_rate(usage: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Unresolved rows over all rows of each repo."""
    counts = usage.groupBy("repo_id").agg(F.count("*").alias("usages")).join(unresolved.groupBy("repo_id").agg(F.count("*").alias("unresolved")), "repo_id", "full")
    counts = counts.fillna(0, ["usages", "unresolved"])
    return counts.withColumn("rate", X.ratio(F.col("unresolved"), F.col("usages") + F.col("unresolved")))


def rate_warnings(rates: DataFrame, threshold: float = 0.05) -> DataFrame:
    text = F.concat(F.lit("unresolved-dynamic rate "), F.format_string("%.2f", F.col("rate") * 100), F.lit("% exceeds threshold "), F.lit(f"{threshold * 100:.2f}"), F.lit("%"))
    return rates.where(F.col("rate") > threshold).select("repo_id", F.lit("unresolved-dynamic-rate-exceeded").alias("code"), text.alias("message"))


def meta(usage: DataFrame, shadow: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Distinct repos and files over all kinds of rows."""
    files = usage.select("repo_id", "file_path").unionByName(shadow.select("repo_id", "file_path")).unionByName(unresolved.select("repo_id", "file_path")).distinct()
    return files.agg(F.countDistinct("repo_id").alias("repos_scanned"), F.count("*").alias("files_scanned"))


def scalars(per_repo: DataFrame, groups: DataFrame, packages: DataFrame) -> DataFrame:
    """What the report shows beside the metrics: mean of repos, groups, packages, confirmed groups."""
    a = per_repo.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_adoption"))
    b = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("level") == "confirmed").cast("long").alias("confirmed"))
    c = packages.agg(F.count("*").alias("packages"))
    # three frames of one row become one row
    every = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return every.agg(*[F.max(x).alias(x) for x in ("mean_adoption", "groups", "confirmed", "packages")])


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Adds ``share``, the row's part of the sum; the sum is one joined row, not a window over all."""
    total = df.agg(F.sum(column).alias("__total"))
    return df.join(F.broadcast(total)).withColumn("share", X.ratio(F.col(column), F.col("__total"))).drop("__total")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
