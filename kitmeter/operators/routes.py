"""Binding files to application routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..session import checkpoint
from . import closures, trace
from .metrics import first_by


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(repo_id, file, node, path): the path of each node of the route arrays under those of its parents.

    ``nodes``: repo_id, file, node, parent (null at the top), segment (null where a node adds nothing). Nodes point at their parents,
    and in each round further up by as much as they know, so a tree of depth d takes log2(d) rounds of joins.
    """
    known = F.when(F.col("segment").isNull(), F.array().cast("array<string>")).otherwise(F.array("segment"))
    state = checkpoint(nodes.select("repo_id", "file", "node", F.col("parent").alias("up"), known.alias("parts")))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select("repo_id", "file", F.col("node").alias("up"), F.col("up").alias("next"), F.col("parts").alias("before"))
        state = state.join(above, ["repo_id", "file", "up"], "left")
        parts = F.concat(F.coalesce("before", F.array().cast("array<string>")), "parts")
        state = checkpoint(state.select("repo_id", "file", "node", F.col("next").alias("up"), parts.alias("parts")))
    return state.select("repo_id", "file", "node", F.aggregate("parts", F.lit(""), X.join_path).alias("path"))


def pages(nodes: DataFrame, bindings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo_id, file, node, page, symbol, warning): the file of each node's page, by the first of its candidates that is a file of the repo.

    ``nodes``: repo_id, file, node, page (none, dynamic, lazy, name or names), names; ``bindings``: repo_id, file, local, source, imported, target
    (null unless a file of the repo); ``resolved``: repo_id, file, source, kind, target.
    """
    key = ["repo_id", "file", "node"]
    null = F.lit(None).cast("string")
    name = F.get("names", F.lit(0))
    plain = nodes.where("page IN ('none', 'dynamic')").select(*key, null.alias("target"), null.alias("symbol"), F.when(F.col("page") == "dynamic", F.concat(F.lit("page-unresolved:"), name)).alias("warning"))
    inside = resolved.where("kind = 'in-repo'").select("repo_id", "file", "source", "target")
    lazy = nodes.where("page = 'lazy'").select(*key, name.alias("source")).join(inside, ["repo_id", "file", "source"], "left")
    lazy = lazy.select(*key, "target", F.when(F.col("target").isNotNull(), "default").alias("symbol"), F.when(F.col("target").isNull(), "lazy-import-not-in-repo").alias("warning"))
    tried = nodes.where("page IN ('name', 'names')").select(*key, "page", F.posexplode_outer("names").alias("pos", "tag")).withColumn("local", F.substring_index("tag", ".", 1))
    tried = tried.join(bindings.select("repo_id", "file", "local", "source", "imported", "target"), ["repo_id", "file", "local"], "left")
    member, missing = F.col("tag").contains("."), F.col("source").isNull()
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    tag, local, source = F.col("tag"), F.col("local"), F.col("source")
    warning = (
        F.when(tag.isNull(), "no-jsx-candidate-resolved")
        .when(missing & member, text("jsx-member-base-not-imported:", local, " of ", tag))
        .when(missing, text("page-not-imported:", tag))
        .when(member, text("jsx-member-unresolved:", tag, ", as ", local, " is from ", source))
        .otherwise(text("page-import-not-in-repo:", tag, ", ", source, " is elsewhere"))
    )
    found = F.col("target").isNotNull()
    symbol = F.when(~found, F.when(F.col("page") == "name", tag)).when(member, tag).otherwise(F.coalesce("imported", "tag"))
    # the first that is found, else the first warning
    best = F.min_by(F.struct("target", symbol.alias("symbol"), F.when(~found, warning).alias("warning")), F.struct((~found).alias("lost"), "pos"))
    tried = tried.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")
    return plain.unionByName(lazy).unionByName(tried).withColumnRenamed("target", "page")


def entries(nodes: DataFrame, constants: DataFrame, bindings: DataFrame, exports: DataFrame, named: DataFrame, stars: DataFrame, own: DataFrame, files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo_id, path, page, symbol, warning, site, ord): the route entries of all repos; ``ord`` sorts as they are discovered.

    ``nodes``: repo_id, file, node, parent, path (kind, text; null without one), page, names. The others as in ``trace``. A node whose path is no
    constant has no entry, and its children stay.
    """
    node_id = F.concat_ws("\0", "repo_id", "file", "node")
    nodes = nodes.withColumn("id", node_id)
    literal = F.when(F.col("path.kind") == "str", F.col("path.text"))
    wanted = nodes.where("path IS NOT NULL AND path.kind <> 'str'").select("id", "repo_id", "file", "path.kind", "path.text")
    values = trace.constants(wanted, constants, bindings, exports, stars, files)
    nodes = checkpoint(nodes.join(values.select("id", "value"), "id", "left").withColumn("segment", F.coalesce(literal, "value")))
    paths = tree_paths(nodes.select("repo_id", "file", "node", "parent", "segment"))
    live = nodes.where("segment IS NOT NULL")
    shown = checkpoint(pages(live.select("repo_id", "file", "node", "page", "names"), bindings, resolved))
    last = F.substring_index("symbol", ".", -1)
    ends = shown.where("page IS NOT NULL").select("repo_id", F.col("page").alias("file"), last.alias("symbol")).distinct()
    ends = trace.defining_file(ends, named, stars, own)
    joined = shown.withColumn("tail", F.when(F.col("page").isNotNull(), last))
    joined = joined.join(ends.select("repo_id", F.col("file").alias("page"), F.col("symbol").alias("tail"), "def_file", "def_symbol"), ["repo_id", "page", "tail"], "left")
    joined = joined.join(paths, ["repo_id", "file", "node"])
    order = F.concat_ws("\0", "file", F.lpad(F.col("node").cast("string"), 9, "0"))
    return joined.select("repo_id", "path", F.col("def_file").alias("page"), F.coalesce("def_symbol", "symbol").alias("symbol"), "warning", F.col("file").alias("site"), order.alias("ord"))


def last_entry(entries: DataFrame) -> DataFrame:
    """Of entries with one (repo_id, path) the last in discovery order (``ord``)."""
    return first_by(entries, ["repo_id", "path"], [F.col("ord").desc()])


def enabled(own, shared):
    """Whether routes are looked for: the repo's setting, else the shared one, else yes."""
    return F.coalesce(own, shared, F.lit(True))


def import_edges(resolved: DataFrame) -> DataFrame:
    """(repo_id, src, dst): distinct edges between files of a repo; names fold case. ``resolved``: repo_id, file, kind, target."""
    return resolved.where("kind = 'in-repo'").select("repo_id", F.lower("file").alias("src"), F.lower("target").alias("dst")).distinct()


def route_files(entries: DataFrame, edges: DataFrame, sites: DataFrame, depth: int = closures.REACH_DEPTH) -> DataFrame:
    """(repo_id, path, file): files reachable from a route's page, and every router file of the repo.

    ``entries``: repo_id, path, page, ord (page may be null); ``sites``: repo_id, file.
    """
    chosen = last_entry(entries)
    pages = chosen.where("page IS NOT NULL").select("repo_id", "path", F.col("page").alias("root"))
    reach = closures.reachable(edges, pages.select("repo_id", "root").distinct(), depth)
    found = pages.join(reach, ["repo_id", "root"]).select("repo_id", "path", F.col("node").alias("file"))
    # a repo has few router files; the join is on repo_id
    return found.unionByName(chosen.select("repo_id", "path").join(sites, "repo_id").select("repo_id", "path", "file")).distinct()


def bind_files(files: DataFrame, bound: DataFrame) -> DataFrame:
    """(repo_id, file, route) of every parsed file of the repos that have routes: none
    unmapped, one bound, more shared with their sorted paths."""
    routed = bound.select("repo_id").distinct()
    per = bound.groupBy("repo_id", "file").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    n = F.coalesce(F.size("paths"), F.lit(0))
    route = F.struct(
        F.when(F.col("paths").isNull() | (n < 1), "unmapped").when(n == 1, "bound").otherwise("shared").alias("kind"),
        F.when(n == 1, F.get("paths", F.lit(0))).alias("path"),
        F.when(n > 1, F.col("paths")).alias("paths"),
    )
    return files.join(routed, "repo_id", "left_semi").join(per, ["repo_id", "file"], "left").select("repo_id", "file", route.alias("route"))


def apply_routes(usage: DataFrame, file_routes: DataFrame) -> DataFrame:
    """Usages with their file's route; without one they stay unsupported."""
    none = F.struct(F.lit("unsupported").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<string>").alias("paths"))
    joined = usage.drop("route").join(file_routes.select("repo_id", F.col("file").alias("file_path"), "route"), ["repo_id", "file_path"], "left")
    return joined.withColumn("route", F.coalesce("route", none))


def mark_multi_route(shadow: DataFrame, file_routes: DataFrame) -> DataFrame:
    """Adds the signal ``multi-route`` once to shadows in shared files; the level stays."""
    shared = file_routes.where(F.col("route.kind") == "shared").select("repo_id", F.col("file").alias("file_path"), F.lit(True).alias("__shared"))
    joined = shadow.join(shared, ["repo_id", "file_path"], "left")
    return joined.withColumn("signals", F.when(F.col("__shared"), F.array_union("signals", F.array(F.lit("multi-route")))).otherwise(F.col("signals"))).drop("__shared")


def warning_rows(entries: DataFrame) -> DataFrame:
    """Route warnings: the code before the colon, as one kind of warning."""
    return entries.where("warning IS NOT NULL").select("repo_id", F.lit("route-resolution-warning").alias("code"), F.col("warning").alias("message"), F.substring_index("warning", ":", 1).alias("sub_code"))
