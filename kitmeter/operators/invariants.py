"""Data-quality checks. Each is a count of offending rows; none means the dataset is consistent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BUCKETS, ROUTE_KINDS, SOURCES


def row_checks(usage: DataFrame) -> DataFrame:
    """code, count of the checks that look at one usage at a time (one pass)."""
    one = lambda c: F.count_if(F.coalesce(c, F.lit(True))).cast("long")
    checks = {
        "invalid-bucket": F.col("bucket").isNull() | ~F.col("bucket").isin(*BUCKETS),
        "unknown-source": F.col("classification_source").isNull() | ~F.col("classification_source").isin(*SOURCES),
        "level-iff-shadow": F.col("shadow_level").isNotNull() != F.coalesce(F.col("bucket") == "shadow", F.lit(False)),
        "ds-package-missing": (F.col("category") == "ds") & F.col("ds_package").isNull(),
        "invalid-route": F.col("route.kind").isNull() | ~F.col("route.kind").isin(*ROUTE_KINDS),
    }
    wide = usage.agg(*[one(c).alias(code) for code, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(f"`{code}`").alias("count")) for code in checks])).alias("x")).select("x.*")


def completeness(usage: DataFrame, shadow: DataFrame, coverage: DataFrame) -> DataFrame:
    """Both sums must be those of the usages."""
    sides = usage.agg(F.count_if(F.col("bucket") == "shadow").alias("s"), F.count_if(F.col("category") == "ds").alias("d"))
    by_file = shadow.agg(F.coalesce(F.sum("usage_count"), F.lit(0)).alias("x"))
    packages = coverage.agg(F.coalesce(F.sum("instances"), F.lit(0)).alias("y"))
    row = sides.join(F.broadcast(by_file)).join(F.broadcast(packages))
    pair = lambda code, a, b: F.struct(F.lit(code).alias("code"), F.abs(F.col(a) - F.col(b)).cast("long").alias("count"))
    return row.select(F.explode(F.array(pair("dataset-completeness-shadow", "s", "x"), pair("dataset-completeness-coverage", "d", "y"))).alias("z")).select("z.*")


def single_version(versions: DataFrame) -> DataFrame:
    """``schema_version`` over all records has one value."""
    return versions.agg((F.greatest(F.countDistinct("schema_version"), F.lit(1)) - 1).cast("long").alias("count")).select(F.lit("mixed-schema-version").alias("code"), "count")


def route_recompute(usage: DataFrame, per_route: DataFrame) -> DataFrame:
    """The route metric counts bound usages only."""
    own = usage.where(F.col("route.kind") == "bound").agg(F.count_if(F.col("bucket").isin("adoption", "shadow")).alias("a"))
    other = per_route.agg(F.coalesce(F.sum(F.col("adoption") + F.col("shadow")), F.lit(0)).alias("b"))
    return own.join(F.broadcast(other)).select(F.lit("per-route-bound-only").alias("code"), F.abs(F.col("a") - F.col("b")).cast("long").alias("count"))


def violations(usage: DataFrame, shadow: DataFrame, coverage: DataFrame, per_route: DataFrame) -> DataFrame:
    """code, count of what fails."""
    parts = [row_checks(usage), completeness(usage, shadow, coverage), route_recompute(usage, per_route)]
    return reduce(DataFrame.unionByName, parts).where("count > 0")


#: Limbs of a row's digest, of 64 bits each.
LIMBS = 4


def _canonical(column: Column, kind: str) -> Column:
    """A value as text with its length before it, so that no two rows of values read alike; ``~`` for null."""
    text = F.to_json(F.struct(column.alias("v"))) if kind.startswith(("struct", "array", "map")) else column.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def digest_limbs(df: DataFrame, *by: str) -> DataFrame:
    """rows, and the limbs of the rows' SHA-256 added up, of the whole table or of each group. Sums of parts are the sums of
    the whole, so parts can be digested apart, and days added to a digest, by ``merged_digest``."""
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), _canonical(F.col(f"`{c}`"), kinds[c])) for c in sorted(df.columns)]), 256)
    limb = lambda k: F.conv(F.substr("h", F.lit(16 * k + 1), F.lit(16)), 16, 10).cast("decimal(20,0)")
    hashed = df.select(*by, row.alias("h")).select(*by, *[limb(k).alias(f"l{k}") for k in range(LIMBS)])
    return hashed.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(f"l{k}").cast("decimal(38,0)").alias(f"l{k}") for k in range(LIMBS)])


def merged_digest(parts: DataFrame) -> DataFrame:
    """rows and digest of all the parts' rows together, whatever parts they are in: each limb modulo 2^64."""
    total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(f"l{k}"), F.lit(0).cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)])
    whole = F.expr("CAST(18446744073709551616 AS DECIMAL(38,0))")
    return total.select("rows", F.concat_ws("-", *[F.pmod(F.col(f"l{k}").cast("decimal(38,0)"), whole).cast("decimal(20,0)").cast("string") for k in range(LIMBS)]).alias("digest"))


def content_hash(df: DataFrame) -> DataFrame:
    """rows and digest of a bag of rows, whatever their order: equal for equal runs."""
    return merged_digest(digest_limbs(df))
