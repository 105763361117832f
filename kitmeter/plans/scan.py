"""The whole scan: sources on disk to usages, shadows, routes, metrics and files.

All repositories go through one plan. Files are rows of a data source, read and
parsed where the tasks run; what follows is joins and aggregates keyed by repo and file: module
resolution, constants, pages and what defines them too, and the registries of packages and libraries.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import closures, counters, invariants, joins, metrics, modules, recommend, routes, rules
from ..operators.metrics import first_by
from ..schema import SHADOW, USAGE, WARNING, Vocabulary
from ..session import checkpoint
from ..sources import config as C
from ..sources import files, records, sinks
from . import prescan
from .facts import facts_of, specifiers

VERSION = "0.1.0"


@dataclass
class Scan:
    usage: DataFrame
    shadow: DataFrame
    unresolved: DataFrame
    warnings: DataFrame
    files: int
    repos: int
    ds_version: str = "unknown"


def resolve_modules(facts: DataFrame, listing: DataFrame, configs: DataFrame) -> DataFrame:
    """(repo_id, file, source, kind, target) of each specifier. ``listing``: repo_id, path; ``configs``: repo_id, folder, tsconfig."""
    return modules.resolve(specifiers(facts), listing, configs)


def route_entries(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo_id, path, page, symbol, warning, site, ord): the route entries that the files' arrays make."""
    each = lambda x: facts.select("repo_id", "file", F.explode(x).alias("x")).select("repo_id", "file", "x.*")
    inside = checkpoint(resolved.where("kind = 'in-repo'").select("repo_id", "file", "source", "target"))
    linked = lambda df: df.join(inside, ["repo_id", "file", "source"], "left")
    own = facts.select("repo_id", "file", F.explode("own").alias("symbol"))
    stars = linked(each("stars").where("exported IS NULL"))
    return routes.entries(each("routes"), each("constants"), linked(each("bindings")), each("local_exports"), linked(each("named")), stars, own, facts.select("repo_id", "file"), resolved)


def scan(spark: SparkSession, c: C.Config, repos: list[C.Repo]) -> Scan:
    known = prescan.registry(spark, c.ds_root)
    ds, reexports = known.packages, known.reexports
    libraries, places = [], {}
    for repo in repos:
        own = {x.lib_id for x in repo.libraries}
        for k, lib in enumerate(C.effective_libraries(c.libraries, repo.libraries)):
            prefix = os.path.relpath(lib.path, repo.root).replace(os.sep, "/").lower()
            libraries.append((repo.repo_id, lib.lib_id, X.glob_to_regex(lib.pattern), "\0" if prefix.startswith("..") else prefix.rstrip("/") + "/", lib.kind, k))
            places[repo.repo_id, lib.lib_id] = prescan.place(lib, repo.root, repo.tsconfig) if lib.lib_id in own else prescan.place(lib, c.base, "tsconfig.json")

    # the files: once their names, once the contents of those to be parsed
    trees = [{"tree": r.repo_id, "root": r.root, "include": [X.glob_to_regex(g) for g in r.include], "exclude": [X.glob_to_regex(g, True) for g in (*C.EXCLUDE, *r.exclude)]} for r in repos]
    listing = files.read(spark, trees, content=False).where("path IS NOT NULL").select(F.col("tree").alias("repo_id"), "path")
    configs = files.read(spark, [{"tree": r.repo_id, "root": r.root, "only": [r.tsconfig]} for r in repos])
    configs = configs.select(F.col("tree").alias("repo_id"), X.dirname(F.col("path")).alias("folder"), F.col("content").alias("tsconfig"))
    sources = files.read(spark, trees).where("content IS NOT NULL OR message IS NOT NULL").select(F.col("tree").alias("repo_id"), F.col("path").alias("file"), "abs_path", F.col("content").alias("source"), "message")
    libs = spark.createDataFrame(libraries, "repo_id string, lib_id string, pattern string, prefix string, kind string, ord int")
    of = spark.createDataFrame([(r, k, p.key) for (r, k), p in places.items()], "repo_id string, lib_id string, key string")
    backed, failed = prescan.backing(spark, list(places.values()), ds)
    backing = of.join(backed, "key").select("repo_id", "lib_id", "symbol", "backed")
    failed = of.join(failed, "key").select("repo_id", "lib_id")

    # folders hold different numbers of files; parsing is dealt evenly
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    every = checkpoint(facts_of(sources.repartition(partitions, "repo_id", "file"), c.snippet_lines))
    facts = every.where("code IS NULL")
    resolved = checkpoint(resolve_modules(facts, listing, configs))

    # imports with what they resolve to
    imports = facts.select("repo_id", "file", F.explode("bindings").alias("b")).select("repo_id", "file", "b.*")
    imports = joins.ds_match(imports.join(resolved, ["repo_id", "file", "source"]), ds)
    imports = imports.withColumns({"resolved_file": F.when(F.col("kind") == "in-repo", F.lower("target")), "import_id": F.concat_ws("\0", "repo_id", "file", "local")})
    imports = joins.canonical_package(imports, reexports)
    imports = imports.join(joins.match_library(imports.where("NOT is_ds_package").select("import_id", "repo_id", "source", "resolved_file"), libs), "import_id", "left")
    imports = checkpoint(joins.library_backing(imports, backing).drop("import_id"))

    # usages, stage A
    elements = facts.select("repo_id", "file", F.explode("elements").alias("e")).select("repo_id", "file", "e.*")
    bound = joins.bind(elements, imports)
    bound = rules.stage_a(bound.withColumn("resolved_kind", F.col("kind")))
    in_library, has = F.col("rule") == 4, F.col("source").isNotNull()
    bound = checkpoint(bound.withColumns({
        "ds_package": F.when(F.col("rule") == 2, F.col("ds_package")),
        "canonicalized_via": F.when(F.col("rule") == 2, F.col("canonicalized_via")),
        "def_file": F.when(has & (F.col("kind") == "in-repo"), F.lower("target")).otherwise(F.lower("file")),
        "symbol": joins.defining_symbol(F.col("tag"), F.col("imported"), in_library, has),
    }))

    # profiles, and their aliases through barrels
    flat = facts.select("repo_id", "file", F.explode("profiles").alias("p")).select("repo_id", "file", "p.*")
    per_file = imports.groupBy("repo_id", "file").agg(F.bool_or("is_ds_package").alias("has_ds_import"), F.collect_list(F.when(F.col("is_ds_package"), F.struct("local", F.coalesce("imported", F.lit("default")).alias("symbol")))).alias("ds"))
    flat = flat.join(per_file, ["repo_id", "file"], "left").withColumns({"has_ds_import": F.coalesce("has_ds_import", F.lit(False)), "ds": F.coalesce("ds", F.array().cast("array<struct<local:string,symbol:string>>"))})
    names = F.transform("ds", lambda d: d["local"])
    used = F.array_union("tags", "wrapped")
    profiles = flat.withColumns({
        "customizes_ds": F.arrays_overlap("customized", names),
        "wraps_ds_with_styled": F.arrays_overlap("wrapped", names),
        "ds_imports": F.array_sort(F.array_distinct(F.transform(F.filter("ds", lambda d: F.array_contains(used, d["local"])), lambda d: F.when(d["symbol"] == "*", "default").otherwise(d["symbol"])))),
        "local_imports": F.array_sort(F.array_except("tags", names)),
        "profile_id": F.concat_ws("\0", "repo_id", F.lower("file"), "symbol"),
    }).withColumnsRenamed({"file": "file_path"})
    # a later profile of one key replaces an earlier one; keys fold case
    profiles = checkpoint(first_by(profiles.withColumn("component_name", F.col("symbol")), ["profile_id"], [F.col("file_path").desc()]))
    keys = profiles.select("repo_id", F.lower("file_path").alias("file"), "symbol", "profile_id")
    inside = resolved.where("kind = 'in-repo'").select("repo_id", "file", "source", F.lower("target").alias("target"))
    order = F.concat_ws("\0", "file", F.lpad(F.col("ord").cast("string"), 9, "0"))
    named = facts.select("repo_id", "file", F.explode("named").alias("n")).select("repo_id", "file", "n.*").join(inside, ["repo_id", "file", "source"]).select("repo_id", F.lower("file").alias("file"), "exported", "target", "local", order.alias("ord"))
    stars = facts.select("repo_id", "file", F.explode("stars").alias("s")).select("repo_id", "file", "s.*").where("exported IS NULL").join(inside, ["repo_id", "file", "source"]).select("repo_id", F.lower("file").alias("file"), "target", order.alias("ord"))
    aliases = checkpoint(closures.alias_closure(keys, named, stars)).withColumnRenamed("file", "def_file")

    # counters, stage B
    pending = bound.where("pending").withColumn("importer", F.lower("file"))
    counts = counters.usage_counters(pending.select("repo_id", "def_file", "symbol", "importer"), aliases)
    names_of = rules.primitives_of(spark.createDataFrame([(r.repo_id, r.primitives) for r in repos], "repo_id string, own array<string>"), c.primitives)
    judged = profiles.join(counts, "profile_id", "left").fillna(0, ["usage_count", "files_used_in"]).join(names_of, "repo_id")
    judged = checkpoint(rules.stage_b(judged, F.col("primitives"), c.reusable_files, c.substantial_elements))
    verdict = judged.select("profile_id", F.col("bucket").alias("b_bucket"), F.col("classification_source").alias("b_source"), F.col("shadow_level").alias("b_level"))
    done = rules.finalise(bound, aliases, verdict)

    none = F.array().cast("array<string>")
    synthetic = pending.join(aliases, ["repo_id", "def_file", "symbol"], "left_anti").where("rule = 4")
    synthetic = counters.synthetic_shadows(synthetic.select("repo_id", "def_file", "symbol", F.col("tag").alias("component_name"), F.col("file").alias("file_path"), "local_lib_id", F.col("file").alias("file_ord"), F.col("ord").alias("site_ord")))
    synthetic = synthetic.withColumns({"prop_names": none, "jsx_element_count": F.lit(0), "local_imports": none, "ds_imports": none, "html_tags": none, "uses_styled": F.lit(False), "code_snippet": F.lit(""), "code_snippet_truncated": F.lit(False), "signals": none})
    columns = [f.name for f in SHADOW]
    shadow = counters.shadow_rows(judged, synthetic, columns)

    # routes
    off = [r.repo_id for r in repos if not (c.routes if r.routes is None else r.routes)]
    routed = facts if not off else facts.where(~F.col("repo_id").isin(off))
    entries = checkpoint(route_entries(routed, resolved)).withColumn("page", F.lower("page"))
    edges = routes.import_edges(resolved)
    bound_files = routes.route_files(entries, edges, routed.where("sites > 0").select("repo_id", F.lower("file").alias("file")), c.depth)
    file_routes = routes.bind_files(routed.select("repo_id", F.lower("file").alias("file")), bound_files)
    file_routes = checkpoint(routed.select("repo_id", "file", F.lower("file").alias("k")).join(file_routes.withColumnRenamed("file", "k"), ["repo_id", "k"]).select("repo_id", "file", "route"))

    usage = done.select("repo_id", F.col("file").alias("file_path"), "line", "col", F.col("tag").alias("component_name"), "category", "bucket", "shadow_level", "classification_source", "ds_package", "canonicalized_via", "local_lib_id", "ds_backed_by_lib", F.lit("static").alias("resolution"))
    usage = checkpoint(routes.apply_routes(usage, file_routes).select(*[f.name for f in USAGE]))
    shadow = checkpoint(routes.mark_multi_route(shadow, file_routes).select(*columns))
    warned = every.where("code IS NOT NULL").select("repo_id", F.col("file").alias("file_path"), "abs_path", "code", "message")
    of_routes = routes.warning_rows(entries).select("repo_id", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("abs_path"), "code", "message").distinct()
    none_of = F.lit(None).cast("string")
    of_libraries = failed.select("repo_id", none_of.alias("file_path"), none_of.alias("abs_path"), F.lit("local-lib-prescan-failed").alias("code"), F.concat(F.lit('Local library "'), "lib_id", F.lit('" prescan failed; components fall back to config.kind')).alias("message"))
    warnings = checkpoint(warned.unionByName(of_routes).unionByName(of_libraries).select(*[f.name for f in WARNING]))
    unresolved = records.empty(spark)["unresolved"]
    return Scan(usage, shadow, unresolved, warnings, facts.count(), len(repos), C.describe(c.ds_root))


def aggregates(s: Scan, c: C.Config, v: Vocabulary = Vocabulary(), duration_ms: int = 0, ds_version: str = "unprescanned") -> dict[str, Any]:
    """The nested result document. Metric frames are small; each is collected sorted."""
    u, sh = s.usage, s.shadow
    per_repo, coverage, groups = metrics.per_repo_adoption(u), metrics.coverage(u), metrics.shadow_by_component(sh)
    per_route = metrics.per_route_adoption(u)
    get = lambda df, *order: [r.asDict(True) for r in df.orderBy(*order).collect()]
    total, spread = get(metrics.global_adoption(u), "value")[0], get(metrics.bucket_distribution(u), "adoption")[0]
    t = recommend.Thresholds(c.min_repos, c.outreach_max, c.promote_ratio, c.most)
    advice = get(recommend.recommendations(groups, per_repo, coverage, s.repos, t), "position")
    bad = get(invariants.violations(u, sh, coverage, per_route), "code")
    rates = metrics.rate_warnings(metrics.unresolved_rate(u, s.unresolved), c.unresolved_rate)
    warnings = [{k: x for k, x in (("repoId", r["repo_id"]), ("filePath", r["file_path"]), ("absPath", r["abs_path"]), ("code", r["code"]), ("message", r["message"])) if x is not None} for r in get(s.warnings, "repo_id", "file_path", "code", "message")]
    warnings += [{"repoId": r["repo_id"], "code": r["code"], "message": r["message"]} for r in get(rates, "repo_id")]
    split = lambda r: {"value": r["value"], "adoption": r["adoption"], "shadow": r["shadow"]}

    def route(r: dict[str, Any]) -> dict[str, Any]:
        return {"kind": r["route_kind"]} | ({"path": r["route_path"]} if r["route_path"] else {})

    return {
        "schemaVersion": "1.1",
        "meta": {"scannerVersion": VERSION, "scannedAt": datetime.now(timezone.utc).isoformat(), "scanDurationMs": duration_ms, v.field("ds_version"): ds_version, "reposScanned": s.repos, "filesScanned": s.files},
        "metrics": {
            "globalAdoption": {"value": total["value"], "formula": total["formula"], "adoption": total["adoption"], "shadow": total["shadow"]},
            "perRepoAdoption": [{"repoId": r["repo_id"], **split(r)} for r in get(per_repo, "repo_id")],
            "shadowLandscape": {
                "byFile": [{"repoId": r["repo_id"], "filePath": r["file_path"], "componentName": r["component_name"], "level": r["shadow_level"], "signals": r["signals"], "usageCount": r["usage_count"], "filesUsedIn": r["files_used_in"], "primaryRoute": route(r)} for r in get(metrics.shadow_by_file(sh, u), "repo_id", "file_path", "component_name")],
                "byComponent": [{"groupKey": r["group_key"], "componentName": r["component_name"], "reposCount": r["repos_count"], "totalUsages": r["total_usages"], "implementations": [{"repoId": x["repo_id"], "filePath": x["file_path"]} for x in r["implementations"]], "level": r["level"], "candidate": None} for r in get(groups, "group_key")],
            },
            v.field("ds_coverage"): [{"package": r["package"], "reposUsing": r["repos_using"], "instances": r["instances"]} for r in get(coverage, "package")],
            v.field("ds_component_usage"): [{"componentName": r["component_name"], "package": r["package"], "reposUsing": r["repos_using"], "instances": r["instances"], "adoption": r["adoption"], "shadow": r["shadow"]} for r in get(metrics.component_usage(u), "component_name", "package")],
            "perRouteAdoption": [{"repoId": r["repo_id"], "path": r["path"], **split(r)} for r in get(per_route, "repo_id", "path")],
            "sharedComponentsAdoption": [{"repoId": r["repo_id"], "filePath": r["file_path"], "componentName": r["component_name"], "bucket": r["bucket"], "paths": r["paths"]} for r in get(metrics.shared_components(u), "repo_id", "file_path", "component_name", "bucket")],
            "bucketDistribution": spread,
        },
        "recommendations": [{"kind": v.field("add_to_ds") if r["kind"] == "add-to-ds" else r["kind"], "priority": r["priority"], "title": r["title"], "rationale": r["rationale"], "evidence": {{"add-to-ds": "shadowGroupKeys", "outreach": "repoIds", "promote-package": "packages"}.get(r["kind"], "none"): r["evidence"]} if r["evidence"] else {}} for r in advice],
        "invariants": {"checked": sum(spread.values()), "failed": len(bad), "violations": bad},
        "warnings": warnings,
    }


def run(spark: SparkSession, config_path: str, repos_path: str, output: str | None = None, v: Vocabulary = Vocabulary()) -> dict[str, Any]:
    """Scan, aggregate, write what ``formats`` asks for; returns the result document and its folder."""
    began = time.time()
    c = C.load_config(config_path)
    s = scan(spark, c, C.load_repos(repos_path))
    out = os.path.abspath(output) if output else c.output
    found = aggregates(s, c, v, int((time.time() - began) * 1000), s.ds_version)
    os.makedirs(out, exist_ok=True)
    if "jsonl" in c.formats:
        sinks.write_single_text(records.ordered_json(s.usage, s.shadow, s.unresolved, v), os.path.join(out, "dataset.jsonl"))
    if "aggregates" in c.formats:
        sinks.write_json(found, os.path.join(out, "aggregates.json"))
    sinks.write_json(found["warnings"], os.path.join(out, "warnings.json"))
    if "html" in c.formats:
        sinks.write_report(found, os.path.join(out, "report.html"))
    return found | {"output": out}


def aggregate_dataset(spark: SparkSession, dataset: str, warnings: str | None = None, v: Vocabulary = Vocabulary(), c: C.Config | None = None) -> dict[str, Any]:
    """The result document of an existing dataset; repos and files are counted from its rows."""
    found = records.read_jsonl(spark, dataset, v)
    m = metrics.meta(found["usage"], found["shadow"], found["unresolved"]).first()
    rows = []
    if warnings:
        with open(warnings, encoding="utf-8") as f:
            rows = [(w.get("repoId"), w.get("filePath"), w.get("absPath"), w["code"], w["message"]) for w in json.load(f)]
    s = Scan(found["usage"], found["shadow"], found["unresolved"], spark.createDataFrame(rows, WARNING), m["files_scanned"], m["repos_scanned"])
    return aggregates(s, c or C.Config(""), v)
