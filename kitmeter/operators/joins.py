"""Dimension joins of the classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .metrics import first_by

#: Rows of a registry (packages, re-exports, libraries of a scan) that may be broadcast.
REGISTRY_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast side if its size allows, else as it is."""
    return F.broadcast(df) if df.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS else df


def bind(usages: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each usage with the import binding of its base identifier, if any."""
    left = usages.withColumn("base", X.base_name(F.col("tag")))
    return left.join(bindings.withColumnRenamed("local", "base"), ["repo_id", "file", "base"], "left")


def ds_match(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds package (of an external import) and is_ds_package: whether the design system has it. ``packages``: package, distinct."""
    named = imports.withColumn("package", F.when(F.col("kind") == "external", F.col("target")))
    joined = named.join(small(packages.select("package", F.lit(True).alias("__ds"))), "package", "left")
    return joined.withColumn("is_ds_package", F.coalesce("__ds", F.lit(False))).drop("__ds")


def canonical_package(usages: DataFrame, reexports: DataFrame) -> DataFrame:
    """Adds ds_package and canonicalized_via: a symbol of another package belongs to that one."""
    r = reexports.where("source_pkg <> pkg").select(F.col("pkg").alias("package"), F.col("symbol").alias("imported_symbol"), "source_pkg")
    joined = usages.withColumn("imported_symbol", F.coalesce("imported", F.lit("default"))).join(small(r), ["package", "imported_symbol"], "left")
    return joined.withColumns({"ds_package": F.coalesce("source_pkg", "package"), "canonicalized_via": F.when(F.col("source_pkg").isNotNull(), F.col("package"))}).drop("source_pkg", "imported_symbol")


#: The plain beginning of an anchored expression: characters and escaped marks that nothing repeats.
_LITERAL = r"^\^((?:(?:[A-Za-z0-9_@/ -]|\\[^A-Za-z0-9])(?![?*+{]))*)"


def literal_start(pattern: Column) -> Column:
    """What every match of an anchored expression begins with; '' of one that is not anchored, or that has alternatives outside groups."""
    open_ = F.regexp_replace(pattern, r"\\.|\[[^\]]*\]", "x").rlike(r"^[^(]*\|")
    return F.when(open_, "").otherwise(F.regexp_replace(F.regexp_extract(pattern, _LITERAL, 1), r"\\(.)", "$1"))


def match_library(imports: DataFrame, libraries: DataFrame) -> DataFrame:
    """(import_id, lib_id, lib_kind) of the first library, in order, whose pattern meets
    the specifier or whose folder holds the resolved file. ``libraries``: repo_id,
    lib_id, pattern (regex), prefix, kind, ord.

    Both are looked up: a specifier by its own beginnings of the lengths that the repo's patterns' plain beginnings have, and only what
    has one is compared with the pattern; a file by each folder above it.
    """
    libs = libraries.withColumn("literal", literal_start(F.col("pattern")))
    sizes = libs.groupBy("repo_id").agg(F.array_sort(F.collect_set(F.length("literal"))).alias("sizes"))
    named = imports.select("import_id", "repo_id", "source", "resolved_file").join(small(sizes), "repo_id")
    starts = F.transform(F.filter("sizes", lambda n: n <= F.length("source")), lambda n: F.substr("source", F.lit(1), n))
    found = ["lib_id", "kind", "ord"]
    by_name = named.select("import_id", "repo_id", "source", F.explode(starts).alias("literal"))
    by_name = by_name.join(small(libs.select("repo_id", "literal", "pattern", *found)), ["repo_id", "literal"]).where(F.expr("source RLIKE pattern"))
    parts = F.split("resolved_file", "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    by_folder = named.where("resolved_file IS NOT NULL").select("import_id", "repo_id", F.explode(above).alias("prefix")).join(small(libs.select("repo_id", "prefix", *found)), ["repo_id", "prefix"])
    joined = by_name.select("import_id", *found).unionByName(by_folder.select("import_id", *found))
    return first_by(joined, ["import_id"], [F.col("ord")]).select("import_id", "lib_id", F.col("kind").alias("lib_kind"))


def library_backing(usages: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds lib_backed: what the prescan knows of the symbol in the repo's library, else the library's kind."""
    right = symbols.select("repo_id", "lib_id", F.col("symbol").alias("__symbol"), "backed")
    left = usages.withColumn("__symbol", F.coalesce("imported", F.lit("default")))
    return left.join(small(right), ["repo_id", "lib_id", "__symbol"], "left").withColumn("lib_backed", F.coalesce("backed", F.col("lib_kind") == "partially-backed")).drop("backed", "__symbol")


def override_libraries(shared: DataFrame, own: DataFrame) -> DataFrame:
    """A repo's libraries replace shared ones of the same lib_id, whole; its own come first."""
    rest = shared.join(own.select("repo_id", "lib_id"), ["repo_id", "lib_id"], "left_anti")
    return own.withColumn("scope", F.lit(0)).unionByName(rest.withColumn("scope", F.lit(1)))


def override_registries(shared: DataFrame, own: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (lib_id, symbol, backed) where a repo's library replaces the shared one of its lib_id, whole, and the distinct
    ids of libraries that failed in either (``failed``: lib_id)."""
    rest = shared.join(own.select("lib_id").distinct(), "lib_id", "left_anti")
    return own.unionByName(rest), failed.select("lib_id").distinct()


def defining_symbol(tag, imported, in_library, has_binding):
    """The name a component has where it is defined: of a member the last part (not in libraries), of a default import ``default``."""
    return F.when(~has_binding, tag).when(~in_library & tag.contains("."), X.last_segment(tag)).otherwise(F.coalesce(imported, F.lit("default")))


def evidence_values(evidence: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Values of what a recommendation refers to; missing keys drop out."""
    return evidence.join(values, key)
