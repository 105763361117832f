"""Relational operations of the report: filter, sort, pages, top lists, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import metrics


def text_filter(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any shown cell holds the query, in any case."""
    if not query:
        return df
    q = query.lower()
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.lower(F.col(f"`{c}`").cast("string")).contains(q)
    return df.where(F.coalesce(hit, F.lit(False)))


def table_sort(df: DataFrame, column: str, descending: bool = False, ties: list[str] | None = None) -> list[Column]:
    """Sort columns of a table: levels by severity, others by value, then the ties."""
    key = X.level_rank(F.col(column)) if column in ("level", "shadow_level") else F.col(column)
    return [key.desc() if descending else key.asc(), *[F.col(t) for t in ties or []]]


def page(df: DataFrame, order: list[Column], number: int = 0, size: int = 50) -> DataFrame:
    """One page of a sorted table; Spark plans it as a top-k."""
    return df.orderBy(*order).offset(max(0, number) * size).limit(size)


def pareto(groups: DataFrame, n: int = 10) -> DataFrame:
    """The groups of the most usages, with their width against the first."""
    top = groups.orderBy(F.desc("total_usages"), "component_name", "group_key").limit(n)
    most = groups.agg(F.max("total_usages").alias("__most"))
    return top.join(F.broadcast(most)).select("group_key", "component_name", "total_usages", F.round(X.ratio(F.col("total_usages"), F.col("__most")) * 100, 1).alias("width"))


def top_packages(coverage: DataFrame, n: int = 3) -> DataFrame:
    return coverage.orderBy(F.desc("instances"), "package").limit(n)


def donut(distribution: DataFrame) -> DataFrame:
    """bucket, count, fraction of the three buckets."""
    rows = distribution.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("count")) for b in ("adoption", "shadow", "neither")])).alias("x")).select("x.*")
    return metrics.share_of_total(rows, "count").withColumnRenamed("share", "fraction")


def band(value: Column) -> Column:
    return F.when(value >= 0.7, "high").when(value >= 0.4, "medium").when(value > 0, "low").otherwise("none")


def component_share(usage: DataFrame) -> DataFrame:
    """Components of the design system with their part of all instances in percent."""
    rows = metrics.component_usage(usage)
    return metrics.share_of_total(rows, "instances").withColumn("share_pct", F.round(F.col("share") * 100, 1)).drop("share")


def shadow_levels(groups: DataFrame) -> DataFrame:
    return groups.groupBy("level").agg(F.count("*").alias("groups"), F.sum("total_usages").alias("usages"))
