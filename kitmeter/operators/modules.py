"""Module resolution as joins.

A listing of files is turned into the names it answers to: each file gives a row for each
specifier path that means it, with its rank in the order of lookup, and the least rank of a
name wins. Resolving is then one equality join on (repo, name); no repo is
ever gathered. Alias patterns are an index by the part before their ``*``: a specifier probes
it with its own beginnings of just the lengths that the repo's patterns have, and
the longest match wins.

Relations: ``listing`` (repo_id, path); ``specifiers`` (repo_id, file, source), distinct; ``configs``
(repo_id, folder, tsconfig), at most one row a repo, the text of its configuration and the folder that holds it.

Defined cases: a null or malformed configuration is none; a path that leaves the repo, or a target that starts with a
slash, names no file; a repo without a listing resolves nothing inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .joins import small

#: Extensions in the order of lookup, for a file and for a folder's index.
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx")
#: What a written extension may mean, after the plain lookup.
SWAPS = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx", ".d.ts")}
_OWN_RANK, _INDEX_RANK = 8, 9

_CONFIG = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
_STRING = r'("(?:[^"\\]++|\\.)*+")'


def module_names(listing: DataFrame) -> DataFrame:
    """(repo_id, name, target): the file that each path without its extension, with a written one, or of a folder means."""
    path = F.col("path")

    def named(rank: int, ok: Column, name: Column) -> Column:
        return F.when(ok, F.struct(F.lit(rank).alias("rank"), name.alias("name")))

    def stem(x: str) -> Column:
        return F.substr(path, F.lit(1), F.length(path) - len(x))

    every = [named(k, path.endswith(x), stem(x)) for k, x in enumerate(EXTENSIONS)]
    every += [named(len(EXTENSIONS) + j, path.endswith(x) & stem(x).rlike(r"[^/.][^/]*$"), F.concat(stem(x), F.lit(ext))) for ext, means in SWAPS.items() for j, x in enumerate(means)]
    every.append(named(_OWN_RANK, path.rlike(r"(^|/)\.*[^/.][^/]*\.[jt]sx?$"), path))
    every += [named(_INDEX_RANK + k, F.concat(F.lit("/"), path).endswith(f"/index{x}"), X.dirname(path)) for k, x in enumerate(EXTENSIONS)]
    rows = listing.select("repo_id", "path", F.explode(F.filter(F.array(*every), lambda e: e.isNotNull())).alias("e"))
    return rows.groupBy("repo_id", F.col("e.name").alias("name")).agg(F.min(F.struct("e.rank", "path"))["path"].alias("target"))


def aliases(configs: DataFrame) -> DataFrame:
    """(repo_id, base, ord, head, tail, star, targets) of each pattern; a row without a head for each repo's ``base``, the folder that bare names start from."""
    clean = F.regexp_replace("tsconfig", rf"{_STRING}|//[^\n]*|/\*(?s:.*?)\*/", "$1")
    clean = F.regexp_replace(clean, rf"{_STRING}|,(\s*[}}\]])", "$1$2")
    read = configs.select("repo_id", "folder", F.from_json(clean, _CONFIG)["compilerOptions"].alias("o"))
    base = F.when(F.col("o.baseUrl").isNull(), "").otherwise(X.normal_path(F.concat_ws("/", "folder", "o.baseUrl")))
    read = read.select("repo_id", base.alias("base"), F.col("o.paths").alias("paths"))
    pattern = read.select("repo_id", "base", F.posexplode_outer("paths").alias("ord", "pattern", "targets"))
    at = F.instr("pattern", "*")
    return pattern.select(
        "repo_id", "base", "ord",
        F.when(at > 0, F.substr("pattern", F.lit(1), at - 1)).otherwise(F.col("pattern")).alias("head"),
        F.when(at > 0, F.substr("pattern", at + 1)).otherwise("").alias("tail"),
        (at > 0).alias("star"), "targets",
    )


def alias_tries(bare: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo_id, source, ord, name): the paths that a bare specifier may mean, in order: the targets of its best pattern, then the base folder."""
    size = F.when(F.col("star"), F.length("head"))
    per_repo = patterns.groupBy("repo_id").agg(F.min("base").alias("base"), F.array_sort(F.collect_set(size)).alias("sizes"))
    named = bare.join(small(per_repo), "repo_id", "left").withColumn("base", F.coalesce("base", F.lit("")))
    probe = lambda head, star: F.struct(head.alias("head"), F.lit(star).alias("star"))
    starts = F.transform(F.filter(F.coalesce("sizes", F.array().cast("array<int>")), lambda n: n <= F.length("source")), lambda n: probe(F.substr("source", F.lit(1), n), True))
    probes = named.select("repo_id", "source", F.explode(F.concat(F.array(probe(F.col("source"), False)), starts)).alias("p")).select("repo_id", "source", "p.*")
    met = probes.join(small(patterns.where("head IS NOT NULL")), ["repo_id", "head", "star"])
    rest = F.length("source") - F.length("head") - F.length("tail")
    met = met.where(~F.col("star") | (F.col("source").endswith(F.col("tail")) & (rest >= 0)))
    # an exact name first, then the longest beginning, then the first pattern
    best = F.min_by(F.struct("base", "targets", F.when(F.col("star"), F.substr("source", F.length("head") + 1, rest)).otherwise("").alias("middle")), F.struct("star", (-F.length("head")).alias("size"), "ord"))
    chosen = met.groupBy("repo_id", "source").agg(best.alias("b")).select("repo_id", "source", "b.*")
    targets = chosen.select("repo_id", "source", "base", "middle", F.posexplode("targets").alias("ord", "target")).where("NOT startswith(target, '/')")
    star = F.instr("target", "*")
    filled = F.when(star > 0, F.concat(F.substr("target", F.lit(1), star - 1), "middle", F.substr("target", star + 1))).otherwise(F.col("target"))
    path = lambda x: X.normal_path(F.concat_ws("/", "base", x))
    last = named.select("repo_id", "source", F.lit((1 << 31) - 1).alias("ord"), path(F.col("source")).alias("name"))
    return targets.select("repo_id", "source", "ord", path(filled).alias("name")).unionByName(last)


def resolve(specifiers: DataFrame, listing: DataFrame, configs: DataFrame) -> DataFrame:
    """(repo_id, file, source, kind, target) of each specifier: an in-repo file, an external package, or unresolved."""
    names = module_names(listing)
    relative = F.col("source").rlike(r"^\.\.?(/|$)")
    rooted = F.col("source").startswith("/")
    own = specifiers.where(relative).withColumn("name", X.normal_path(F.concat_ws("/", X.dirname(F.col("file")), "source")))
    kind = F.when(F.col("target").isNotNull(), "in-repo")
    own = own.join(names, ["repo_id", "name"], "left").select("repo_id", "file", "source", F.coalesce(kind, F.lit("unresolved")).alias("kind"), "target")
    # what a bare name means does not depend on the importer
    bare = specifiers.where(~relative & ~rooted)
    tries = alias_tries(bare.select("repo_id", "source").distinct(), aliases(configs))
    found = tries.join(names, ["repo_id", "name"]).groupBy("repo_id", "source").agg(F.min_by("target", "ord").alias("target"))
    bare = bare.join(found, ["repo_id", "source"], "left")
    bare = bare.select("repo_id", "file", "source", F.coalesce(kind, F.lit("external")).alias("kind"), F.coalesce("target", X.package_name(F.col("source"))).alias("target"))
    none = specifiers.where(rooted).select("repo_id", "file", "source", F.lit("unresolved").alias("kind"), F.lit(None).cast("string").alias("target"))
    return own.unionByName(bare).unionByName(none)
