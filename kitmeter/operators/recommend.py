"""Recommendations from the metrics, by thresholds; sorted by priority and capped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that an add recommendation is made of at most.
TOP_GROUPS = 5


@dataclass(frozen=True)
class Thresholds:
    min_repos: int = 5
    outreach_max: float = 0.3
    promote_ratio: float = 0.1
    most: int = 12


def _count(n, one: str, many: str):
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def add_candidates(groups: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The top groups that span enough repos, most repos times usages first."""
    weight = F.col("repos_count") * F.col("total_usages")
    top = groups.where(F.col("repos_count") >= t.min_repos).orderBy(weight.desc(), F.desc("total_usages"), "component_name", "group_key").limit(TOP_GROUPS)
    priority = F.when((F.col("repos_count") >= 2 * t.min_repos) | (F.col("level") == "confirmed"), "high").when(F.col("level") == "likely", "medium").otherwise("low")
    return top.select(
        F.lit("add-to-ds").alias("kind"),
        priority.alias("priority"),
        F.concat(F.lit("Add to the design system: "), "component_name").alias("title"),
        F.concat(F.lit("Reinvented in "), _count(F.col("repos_count"), "repo", "repos"), F.lit(" ("), _count(F.col("total_usages"), "usage", "usages"), F.lit(", level "), "level", F.lit(")")).alias("rationale"),
        F.array("group_key").alias("evidence"),
        (-weight).cast("long").alias("__a"),
        (-F.col("total_usages")).cast("long").alias("__b"),
        F.concat_ws(" ", "component_name", "group_key").alias("__c"),
        F.lit(1).alias("__kind"),
    )


def _summary(rows: DataFrame, kind: str, number: int, priority, title, rationale, order: str, name: str) -> DataFrame:
    """One recommendation over all rows, the evidence in order (value, name)."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("x"), F.count("*").alias("n")).where("n > 0")
    names = F.transform("x", lambda v: v["n"])
    first = F.array_join(F.slice(names, 1, 3), ", ")
    return listed.select(
        F.lit(kind).alias("kind"),
        priority(F.col("n")).alias("priority"),
        title(F.col("n")).alias("title"),
        rationale(first, F.col("n")).alias("rationale"),
        names.alias("evidence"),
        F.lit(0).cast("long").alias("__a"),
        F.lit(0).cast("long").alias("__b"),
        F.lit("").alias("__c"),
        F.lit(number).alias("__kind"),
    )


def outreach(per_repo: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    more = lambda n: F.when(n > 3, F.concat(F.lit(" (+"), (n - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return _summary(
        per_repo.where(F.col("value") < t.outreach_max), "outreach", 2,
        lambda n: F.when(n >= 3, "high").otherwise("medium"),
        lambda n: F.concat(F.lit("Outreach: "), _count(n, "repo", "repos"), F.lit(f" with adoption < {round(t.outreach_max * 100)}%")),
        lambda first, n: F.concat(F.lit("Lowest: "), first, more(n)),
        "value", "repo_id",
    )


def promote(coverage: DataFrame, repos_scanned: int, t: Thresholds = Thresholds()) -> DataFrame:
    limit = max(1, int(repos_scanned * t.promote_ratio))
    rows = coverage.where((F.col("repos_using") > 0) & (F.col("repos_using") < limit) & F.lit(repos_scanned > 0))
    return _summary(
        rows, "promote-package", 3,
        lambda n: F.lit("low"),
        lambda n: F.concat(F.lit("Promote "), _count(n, "package", "packages")),
        lambda first, n: F.concat(F.lit(f"Used in < {round(t.promote_ratio * 100)}% of repos: "), first),
        "repos_using", "package",
    )


def tune(groups: DataFrame) -> DataFrame:
    counts = groups.agg(F.count_if(F.col("level") == "possible").alias("p"), F.count_if(F.col("level") == "confirmed").alias("c"))
    return counts.where("p > 0 AND p > 3 * c").select(
        F.lit("tune-thresholds").alias("kind"),
        F.lit("medium").alias("priority"),
        F.concat(F.lit("Tune thresholds: "), F.col("p").cast("string"), F.lit(" possible vs "), F.col("c").cast("string"), F.lit(" confirmed")).alias("title"),
        F.lit("Most shadow groups are only possible; raise the markup threshold or narrow the primitive names").alias("rationale"),
        F.array().cast("array<string>").alias("evidence"),
        F.lit(0).cast("long").alias("__a"),
        F.lit(0).cast("long").alias("__b"),
        F.lit("").alias("__c"),
        F.lit(4).alias("__kind"),
    )


def recommendations(groups: DataFrame, per_repo: DataFrame, coverage: DataFrame, repos_scanned: int, t: Thresholds = Thresholds()) -> DataFrame:
    """kind, priority, title, rationale, evidence, and ``position`` from 1; high before medium before low."""
    every = add_candidates(groups, t).unionByName(outreach(per_repo, t)).unionByName(promote(coverage, repos_scanned, t)).unionByName(tune(groups))
    weight = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    ranked = every.orderBy(weight, "__kind", "__a", "__b", "__c").limit(t.most)
    # at most TOP_GROUPS + 3 rows
    return ranked.agg(F.array_sort(F.collect_list(F.struct(weight.alias("w"), "__kind", "__a", "__b", "__c", "kind", "priority", "title", "rationale", "evidence"))).alias("x")).select(F.posexplode("x")).select((F.col("pos") + 1).alias("position"), "col.kind", "col.priority", "col.title", "col.rationale", "col.evidence")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "position int, kind string, priority string, title string, rationale string, evidence array<string>")
