"""What is known before a scan: the design system's packages and where their symbols come from, and what the symbols of local libraries are backed by.

Entry files and library files are rows of the source trees, parsed like any others; the rest are joins and the closures over exports.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import closures, modules
from ..operators.metrics import first_by
from ..session import checkpoint
from ..sources import files
from ..sources.config import Library
from .facts import facts_of, specifiers

#: Entry files of a package, in order.
ENTRIES = ("src/index.ts", "src/index.tsx", "index.ts", "src/index.js")
#: Folders of a library that are not looked into.
PRUNED = ("node_modules", "dist", "build", ".git")


@dataclass
class Registry:
    """``packages``: package; ``reexports``: pkg, symbol, source_pkg, source_symbol, hops."""

    packages: DataFrame
    reexports: DataFrame


def registry(spark: SparkSession, root: str) -> Registry:
    from pyarrow import fs

    store, base = files.opened(root)
    if store.get_file_info([f"{base}/packages"])[0].type != fs.FileType.Directory:
        raise FileNotFoundError(f"no packages folder in {root}")
    entry = "|".join(x.replace(".", r"\.") for x in ENTRIES)
    found = files.read(spark, [{"tree": "ds", "root": root, "include": [rf"^packages/[^/]+/(package\.json|{entry})$"]}])
    found = checkpoint(found.where("content IS NOT NULL").select(F.split("path", "/")[1].alias("folder"), F.regexp_extract("path", "^packages/[^/]+/(.*)$", 1).alias("file"), "content"))
    name = F.get_json_object("content", "$.name")
    named = first_by(found.where("file = 'package.json'").select("folder", name.alias("pkg")).where("pkg <> ''"), ["pkg"], [F.col("folder").desc()])
    rank = F.array_position(F.array(*map(F.lit, ENTRIES)), F.col("file"))
    entries = first_by(found.where("file <> 'package.json'").join(named, "folder"), ["pkg"], [rank])
    facts = checkpoint(facts_of(entries.select(F.col("pkg").alias("repo_id"), "file", F.col("content").alias("source"))).where("code IS NULL").withColumnRenamed("repo_id", "pkg"))
    packages = checkpoint(named.select(F.col("pkg").alias("package")))

    each = lambda x: facts.select("pkg", F.explode(x).alias("x"))
    # a name that is imported from another package of the system and exported again is that one's
    imported = each("bindings").select("pkg", F.col("x.local").alias("local"), X.package_name(F.col("x.source")).alias("from_pkg"), F.coalesce("x.imported", F.lit("default")).alias("from_symbol"))
    imported = imported.join(packages.withColumnRenamed("package", "from_pkg"), "from_pkg", "left_semi")
    lists = each("local_exports").select("pkg", "x.*").join(imported, ["pkg", "local"], "left")
    source = lambda x: F.when(F.col(x).startswith("."), F.col("pkg")).otherwise(X.package_name(F.col(x)))
    named_exports = each("named").select("pkg", F.col("x.exported").alias("symbol"), source("x.source").alias("from_pkg"), F.col("x.local").alias("from_symbol"), F.col("x.ord").alias("ord"))
    star_exports = each("stars").select("pkg", "x.exported", source("x.source").alias("from_pkg"), F.col("x.ord").alias("ord"))
    inside = F.col("from_pkg") == F.col("pkg")
    own = facts.select("pkg", F.explode("own").alias("symbol"))
    for more in (lists.where("from_pkg IS NULL").select("pkg", F.col("exported").alias("symbol")), named_exports.where(inside).select("pkg", "symbol"), star_exports.where("exported IS NOT NULL").select("pkg", F.col("exported").alias("symbol"))):
        own = own.unionByName(more)
    through = lists.where("from_pkg IS NOT NULL").select("pkg", F.col("exported").alias("symbol"), "from_pkg", "from_symbol", "ord").unionByName(named_exports.where(~inside))
    through = first_by(through, ["pkg", "symbol"], [F.col("ord").desc(), F.col("from_pkg"), F.col("from_symbol")]).drop("ord")
    stars = star_exports.where("exported IS NULL").where(~inside).select("pkg", "from_pkg", "ord")
    return Registry(packages, checkpoint(closures.reexport_closure(checkpoint(own.distinct()), checkpoint(through), checkpoint(stars))))


@dataclass(frozen=True)
class Place:
    """A library as a repo or the whole configuration names it: its folder, the folder of that scope, and the scope's tsconfig."""

    path: str
    scope: str
    tsconfig: str

    @property
    def key(self) -> str:
        return "\0".join((self.scope, self.path))

    @property
    def within(self) -> str | None:
        """The folder inside its scope, null if it lies elsewhere."""
        rel = os.path.relpath(self.path, self.scope).replace(os.sep, "/")
        return None if rel.startswith("..") else "" if rel == "." else rel + "/"


def place(library: Library, scope: str, tsconfig: str) -> Place:
    return Place(library.path, scope, tsconfig)


def backing(spark: SparkSession, places: list[Place], packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, symbol, backed) of the symbols that libraries export, and (key) of the libraries that could not be read.

    Specifiers inside a library are resolved with the aliases of its scope; a library outside its scope has none.
    """
    places = sorted(set(places), key=lambda p: p.key)
    found = files.read(spark, [{"tree": p.key, "root": p.path, "include": [r"\.[jt]sx?$"], "pruned": PRUNED} for p in places])
    rows = spark.createDataFrame([(p.key, p.within or "", None if p.within is None else p.scope) for p in places], "tree string, prefix string, scope string")
    found = found.join(F.broadcast(rows), "tree")
    failed = found.where("path IS NULL AND message IS NOT NULL").select(F.col("tree").alias("key")).distinct()
    sources = found.where("content IS NOT NULL").select(F.col("tree").alias("repo_id"), F.concat("prefix", "path").alias("file"), F.col("content").alias("source"))
    facts = checkpoint(facts_of(sources).where("code IS NULL"))
    configs = files.read(spark, [{"tree": p.key, "root": p.scope, "only": [p.tsconfig]} for p in places if p.within is not None])
    configs = configs.select(F.col("tree").alias("repo_id"), X.dirname(F.col("path")).alias("folder"), F.col("content").alias("tsconfig"))
    resolved = checkpoint(modules.resolve(specifiers(facts), facts.select("repo_id", F.col("file").alias("path")), configs))

    key = F.col("repo_id").alias("lib_id")
    each = lambda x: facts.select("repo_id", "file", F.explode(x).alias("x"))
    own = each("own").select(key, "file", F.col("x").alias("symbol")).unionByName(each("local_exports").select(key, "file", F.col("x.exported").alias("symbol")))
    own = own.where(X.is_component_name(F.col("symbol"))).distinct()
    bound = each("bindings").select("repo_id", "file", "x.source").join(resolved.where("kind = 'external'"), ["repo_id", "file", "source"])
    uses = bound.join(packages.withColumnRenamed("package", "target"), "target", "left_semi").select("repo_id", "file").distinct()
    flagged = facts.select("repo_id", "file").join(uses.withColumn("uses", F.lit(True)), ["repo_id", "file"], "left").select(key, "file", F.coalesce("uses", F.lit(False)).alias("imports_ds"))
    inside = resolved.where("kind = 'in-repo'").select("repo_id", "file", "source", "target")
    named = each("named").select("repo_id", "file", "x.*").join(inside, ["repo_id", "file", "source"], "left").select(key, "file", F.col("exported").alias("symbol"), "target", "local")
    stars = each("stars").select("repo_id", "file", "x.*").where("exported IS NULL").join(inside, ["repo_id", "file", "source"]).select(key, "file", "target")
    parts = [checkpoint(x.distinct()) for x in (own, flagged, named, stars)]
    backed = closures.backing_closure(*parts).where(X.is_component_name(F.col("symbol")))
    return checkpoint(backed.withColumnRenamed("lib_id", "key")), failed
