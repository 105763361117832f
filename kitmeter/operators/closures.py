"""Bounded closures over export and import edges, as join loops.

Every loop has a fixed number of rounds, the depth limits of the semantics, and
writes each round's frontier to the checkpoint folder, so plans stay small and
an executor's loss costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .metrics import first_by

SYMBOL_DEPTH = 5
BACKING_DEPTH = 5
ALIAS_ROUNDS = 5
REACH_DEPTH = 20


def reachable(edges: DataFrame, starts: DataFrame, depth: int = REACH_DEPTH) -> DataFrame:
    """(repo_id, root, node, hops): nodes within ``depth`` edges of each root, itself at 0.
    ``edges``: repo_id, src, dst; ``starts``: repo_id, root."""
    edges = edges.select("repo_id", F.col("src").alias("node"), "dst").distinct()
    seen = checkpoint(starts.select("repo_id", "root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(edges, ["repo_id", "node"]).select("repo_id", "root", F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(seen, ["repo_id", "root", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def alias_closure(profiles: DataFrame, named: DataFrame, stars: DataFrame, rounds: int = ALIAS_ROUNDS) -> DataFrame:
    """(repo_id, file, symbol, profile_id): profiles under every barrel that exports them.

    ``profiles``: repo_id, file, symbol, profile_id. ``named``: repo_id, file, exported,
    target, local, ord; ``stars``: repo_id, file, target, ord. Existing keys win; in a
    round the first statement wins. Stars pass neither ``default`` nor namespaces.
    """
    known = checkpoint(profiles.select("repo_id", "file", "symbol", "profile_id"))
    for k in range(1, rounds + 1):
        source = known.select("repo_id", F.col("file").alias("target"), F.col("symbol").alias("local"), "profile_id")
        by_name = named.join(source, ["repo_id", "target", "local"]).select("repo_id", "file", F.col("exported").alias("symbol"), "profile_id", "ord")
        by_star = stars.join(source.where("local <> 'default'"), ["repo_id", "target"]).select("repo_id", "file", F.col("local").alias("symbol"), "profile_id", "ord")
        new = by_name.unionByName(by_star).join(known, ["repo_id", "file", "symbol"], "left_anti")
        new = checkpoint(first_by(new, ["repo_id", "file", "symbol"], [F.col("ord"), F.col("profile_id")]).select("repo_id", "file", "symbol", "profile_id"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def reexport_closure(own: DataFrame, named: DataFrame, stars: DataFrame, depth: int = SYMBOL_DEPTH) -> DataFrame:
    """(pkg, symbol, source_pkg, source_symbol, hops) for every symbol of a package.

    Own symbols have 0 hops. A named re-export follows its source: own, then named,
    then stars in order, at most ``depth`` packages. A star passes the own symbols of
    its direct source only. ``own``: pkg, symbol; ``named``: pkg, symbol, from_pkg,
    from_symbol; ``stars``: pkg, from_pkg, ord. Packages outside the registry end a trace.
    """
    zero = own.select("pkg", "symbol", F.col("pkg").alias("source_pkg"), F.col("symbol").alias("source_symbol"), F.lit(0).alias("hops")).distinct()
    # best answer of a trace from (pkg, symbol) within d packages, built from d-1
    trace = checkpoint(zero)
    for _ in range(depth):
        far = trace.select(F.col("pkg").alias("from_pkg"), F.col("symbol").alias("from_symbol"), "source_pkg", "source_symbol", (F.col("hops") + 1).alias("hops"))
        by_name = named.join(far, ["from_pkg", "from_symbol"]).select("pkg", "symbol", "source_pkg", "source_symbol", "hops", F.lit(1).alias("__rank"), F.lit(0).alias("__ord"))
        by_star = stars.join(far, "from_pkg").select("pkg", F.col("from_symbol").alias("symbol"), "source_pkg", "source_symbol", "hops", F.lit(2).alias("__rank"), F.col("ord").alias("__ord"))
        # a symbol that is named is not looked for in stars
        by_star = by_star.join(named.select("pkg", "symbol").distinct(), ["pkg", "symbol"], "left_anti")
        every = zero.withColumns({"__rank": F.lit(0), "__ord": F.lit(0)}).unionByName(by_name).unionByName(by_star)
        every = every.where((F.col("hops") == 0) | (F.col("source_pkg") != F.col("pkg")))
        trace = checkpoint(first_by(every, ["pkg", "symbol"], [F.col("__rank"), F.col("__ord"), F.col("hops"), F.col("source_pkg"), F.col("source_symbol")]).drop("__rank", "__ord"))
    direct = named.join(trace.select(F.col("pkg").alias("from_pkg"), F.col("symbol").alias("from_symbol"), "source_pkg", "source_symbol", (F.col("hops") + 1).alias("hops")), ["from_pkg", "from_symbol"]).where("hops <= " + str(depth + 1))
    fan = stars.join(zero.where("symbol <> 'default'").select(F.col("pkg").alias("from_pkg"), "symbol", "source_pkg", "source_symbol", F.lit(1).alias("hops")), "from_pkg")
    every = (
        zero.withColumns({"__rank": F.lit(0), "__ord": F.lit(0)})
        .unionByName(direct.select("pkg", "symbol", "source_pkg", "source_symbol", "hops", F.lit(1).alias("__rank"), F.lit(0).alias("__ord")))
        .unionByName(fan.select("pkg", "symbol", "source_pkg", "source_symbol", "hops", F.lit(2).alias("__rank"), F.col("ord").alias("__ord")))
    )
    return first_by(every, ["pkg", "symbol"], [F.col("__rank"), F.col("__ord"), F.col("source_pkg"), F.col("source_symbol")]).drop("__rank", "__ord")


def backing_closure(own: DataFrame, files: DataFrame, named: DataFrame, stars: DataFrame, depth: int = BACKING_DEPTH) -> DataFrame:
    """(lib_id, symbol, backed): whether the file that owns a symbol imports the design system.

    ``own``: lib_id, file, symbol; ``files``: lib_id, file, imports_ds; ``named``: lib_id,
    file, symbol, target, local; ``stars``: lib_id, file, target. A named export follows
    named exports and stars to an owner, through at most ``depth`` more files; without one it
    is not backed. A star passes the own components of its direct target. Same-named
    symbols of a library are OR-ed.
    """
    keys = ["lib_id", "file", "symbol"]
    zero = own.join(files, ["lib_id", "file"], "left").select(*keys, F.coalesce("imports_ds", F.lit(False)).alias("backed"))
    zero = checkpoint(zero.groupBy(*keys).agg(F.bool_or("backed").alias("backed")))
    to = lambda df: df.select("lib_id", F.col("file").alias("target"), F.col("symbol").alias("local"), "backed")
    trace = zero
    for _ in range(depth):
        by_name = named.join(to(trace), ["lib_id", "target", "local"]).select(*keys, "backed")
        by_star = stars.join(to(trace), ["lib_id", "target"]).select("lib_id", "file", F.col("local").alias("symbol"), "backed")
        new = by_name.unionByName(by_star).join(zero, keys, "left_anti").groupBy(*keys).agg(F.bool_or("backed").alias("backed"))
        trace = checkpoint(zero.unionByName(new))
    direct = named.join(to(trace), ["lib_id", "target", "local"], "left").select("lib_id", "symbol", F.coalesce("backed", F.lit(False)).alias("backed"))
    fan = stars.join(to(zero).where("local <> 'default'"), ["lib_id", "target"]).select("lib_id", F.col("local").alias("symbol"), "backed")
    every = zero.select("lib_id", "symbol", "backed").unionByName(direct).unionByName(fan)
    return every.groupBy("lib_id", "symbol").agg(F.bool_or("backed").alias("backed"))
