"""Rules, expressions, closures, recommendations and invariants."""

import json
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kitmeter.extract.facts import Facts
from kitmeter.extract.tree import parse
from kitmeter.functions import expressions as X
from kitmeter.operators import closures, invariants, joins, metrics, recommend, rules, tables
from kitmeter.plans import adapters, queries
from kitmeter.sources import config as C
from kitmeter.sources import records, sinks
from kitmeter.streaming import incremental

PROFILE = {"component_name": "Foo", "file_path": "src/Foo.tsx", "jsx_element_count": 1, "has_ds_import": False, "customizes_ds": False, "wraps_ds_with_styled": False, "uses_styled": False, "files_used_in": 0}


@pytest.mark.parametrize(
    ("change", "bucket", "source", "level"),
    [
        ({"component_name": "AuthProvider"}, "neither", "utility-heuristic", None),
        ({"component_name": "ThemeContext", "jsx_element_count": 50}, "neither", "utility-heuristic", None),
        ({"component_name": "UserQuery", "jsx_element_count": 2}, "neither", "utility-heuristic", None),
        ({"component_name": "UserQuery", "jsx_element_count": 5}, "shadow", "parallel-local-ui", "possible"),
        ({"component_name": "AppShell", "jsx_element_count": 3}, "neither", "utility-heuristic", None),
        ({"component_name": "Button", "jsx_element_count": 6}, "shadow", "parallel-local-ui", "confirmed"),
        ({"component_name": "Button", "files_used_in": 2}, "shadow", "parallel-local-ui", "likely"),
        ({"file_path": "src/shared/ui/Foo.tsx"}, "shadow", "parallel-local-ui", "possible"),
        ({"component_name": "ModalContainer", "jsx_element_count": 6}, "neither", "utility-heuristic", None),
        ({"has_ds_import": True, "jsx_element_count": 3}, "adoption", "ds-composition", None),
        ({"has_ds_import": True, "customizes_ds": True}, "shadow", "wraps-with-customization", "possible"),
        ({"has_ds_import": True, "jsx_element_count": 5}, "shadow", "wraps-with-customization", "possible"),
        ({"uses_styled": True}, "shadow", "parallel-local-ui", "possible"),
        ({}, "neither", "utility-heuristic", None),
    ],
)
def test_stage_b(spark, change, bucket, source, level):
    row = PROFILE | change
    got = rules.stage_b(spark.createDataFrame([tuple(row.values())], "component_name string, file_path string, jsx_element_count int, has_ds_import boolean, customizes_ds boolean, wraps_ds_with_styled boolean, uses_styled boolean, files_used_in long")).first()
    assert (got["bucket"], got["classification_source"], got["shadow_level"]) == (bucket, source, level)


@pytest.mark.parametrize(
    ("glob", "yes", "no", "dot"),
    [
        ("src/**/*.{ts,tsx}", ["src/a.ts", "src/a/b/c.tsx"], ["lib/a.ts", "src/a.js", "src/.hidden/a.ts", "src/.a.ts"], False),
        ("**/node_modules/**", ["node_modules/x", "a/node_modules/b/.c"], ["a/modules/b"], True),
        ("**/*.test.*", ["a.test.ts", "x/y.test.tsx"], ["a.ts"], True),
        ("@team/*", ["@team/kit"], ["@team/kit/deep", "team/kit"], False),
        ("a?c[0-9]", ["abc1"], ["ac1", "abcx"], False),
    ],
)
def test_globs(glob, yes, no, dot):
    p = re.compile(X.glob_to_regex(glob, dot))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)


@pytest.mark.parametrize("source", ["const x = <<<<", "const a = (1;", "<div>", "const s = 'open", "`open", "<a></b>", "}"])
def test_parse_failures(source):
    with pytest.raises(SyntaxError):
        parse(source, True)


def test_facts():
    f = Facts("import A, { b as C, type D } from 'x';\nimport * as N from './n';\nexport default function () { return a / b / c; }\nexport const T = ({ a, b: c = 1, ...r }) => <A.B className='q'>{r.map(x => <p key={x}/>)} &lt; text's</A.B>;\nconst re = /<div>/g, t = `a ${<C/>} b`;\nexport { T as U };\nlet q = a < b;", True)
    assert f.bindings == {"A": ("x", None, False), "C": ("x", "b", False), "D": ("x", "D", False), "N": ("./n", "*", True)}
    assert sorted(e["tag"] for e in f.elements) == ["A.B", "C", "p"]
    assert [(p["symbol"], p["prop_names"], p["jsx_element_count"]) for p in f.profiles] == [("default", [], 0), ("T", ["a", "b"], 2)]
    assert f.local_exports == [("T", "U")] and {e["tag"]: (e["line"], e["col"]) for e in f.elements}["A.B"][0] == 4
    assert Facts("export const id = <T>(x: T): T => x as T;", False).profiles == []
    typed = Facts("export function P(props: { a: string; readonly b?: number; m(): void }): { x: 1 } { return <i/> }", True)
    assert typed.profiles[0]["prop_names"] == ["a", "b"] and typed.profiles[0]["jsx_element_count"] == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=16), st.integers(1, 4))
def test_reachability_against_bfs(spark, edges, depth):
    want = set()
    for root in range(3):
        seen, frontier = {root}, {root}
        for _ in range(depth):
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
        want |= {(root, x) for x in seen}
    e = spark.createDataFrame([("r", a, b) for a, b in edges], "repo_id string, src int, dst int")
    starts = spark.createDataFrame([("r", k) for k in range(3)], "repo_id string, root int")
    assert {(r["root"], r["node"]) for r in closures.reachable(e, starts, depth).collect()} == want


def test_export_closures(spark):
    own = spark.createDataFrame([("button", "Button"), ("form", "Form"), ("form", "default"), ("all", "Own")], "pkg string, symbol string")
    named = spark.createDataFrame([("all", "Form", "form", "Form"), ("top", "F", "all", "Form"), ("x", "Lost", "unknown", "Y")], "pkg string, symbol string, from_pkg string, from_symbol string")
    stars = spark.createDataFrame([("all", "button", 0), ("top", "all", 1)], "pkg string, from_pkg string, ord int")
    got = {(r["pkg"], r["symbol"]): (r["source_pkg"], r["source_symbol"], r["hops"]) for r in closures.reexport_closure(own, named, stars).collect()}
    assert got[("all", "Form")] == ("form", "Form", 1) and got[("top", "F")][:2] == ("form", "Form") and got[("all", "Button")] == ("button", "Button", 1)
    assert got[("top", "Own")] == ("all", "Own", 1) and ("top", "Button") not in got and ("x", "Lost") not in got and got[("form", "default")][2] == 0


def test_backing_closure(spark):
    own = spark.createDataFrame([("k", "a", "A"), ("k", "b", "B")], "lib_id string, file string, symbol string")
    files = spark.createDataFrame([("k", "a", True), ("k", "b", False), ("k", "i", False)], "lib_id string, file string, imports_ds boolean")
    named = spark.createDataFrame([("k", "i", "Z", "a", "A"), ("k", "j", "Y", "i", "Z")], "lib_id string, file string, symbol string, target string, local string")
    stars = spark.createDataFrame([("k", "i", "b")], "lib_id string, file string, target string")
    assert {r["symbol"]: r["backed"] for r in closures.backing_closure(own, files, named, stars).collect()} == {"A": True, "B": False, "Z": True, "Y": True}


GROUPS = "group_key string, component_name string, level string, repos_count long, total_usages long"


def groups(spark, rows):
    return spark.createDataFrame([(f"k{i:02}", *r) for i, r in enumerate(rows)], GROUPS)


def test_recommendations(spark):
    t = recommend.Thresholds(3, 0.3, 0.1, 12)
    none = spark.createDataFrame([], "repo_id string, value double"), spark.createDataFrame([], "package string, repos_using long, instances long")
    got = recommend.recommendations(groups(spark, [("Button", "likely", 8, 80), ("Card", "likely", 2, 10)]), *none, 10, t).collect()
    assert [(r["kind"], r["priority"], r["title"]) for r in got] == [("add-to-ds", "high", "Add to the design system: Button")]
    repos = spark.createDataFrame([("c", 0.25), ("a", 0.1), ("b", 0.2), ("d", 0.7)], "repo_id string, value double")
    got = recommend.recommendations(groups(spark, []), repos, none[1], 4, t).collect()
    assert [(r["kind"], r["priority"], r["evidence"]) for r in got] == [("outreach", "high", ["a", "b", "c"])]
    packages = spark.createDataFrame([("p", 80, 9), ("q", 3, 9)], "package string, repos_using long, instances long")
    got = recommend.recommendations(groups(spark, []), none[0], packages, 100, t).collect()
    assert [(r["kind"], r["evidence"]) for r in got] == [("promote-package", ["q"])]
    got = recommend.recommendations(groups(spark, [("X", "possible", 1, 1)] * 10 + [("Y", "confirmed", 1, 1)]), *none, 1, t).collect()
    assert [r["kind"] for r in got] == ["tune-thresholds"]
    many = groups(spark, [(f"N{k}", "possible", 9, 9) for k in range(20)])
    assert recommend.recommendations(many, *none, 0, recommend.Thresholds(3, 0.3, 0.1, 3)).count() == 3
    assert recommend.recommendations(groups(spark, []), *none, 0, t).count() == 0


def test_invariants_find_corrupt_rows(spark, sf_dir):
    u = adapters.usage(spark, sf_dir)
    bad = u.withColumn("bucket", F.when(F.col("line") == 1, "odd").otherwise(F.col("bucket")))
    codes = {r["code"] for r in invariants.row_checks(bad).where("count > 0").collect()}
    assert codes == {"invalid-bucket", "level-iff-shadow"}
    s = adapters.shadow(spark, sf_dir).withColumn("usage_count", F.col("usage_count") + 1)
    assert {r["code"] for r in invariants.violations(u, s, metrics.coverage(u), metrics.per_route_adoption(u)).collect()} == {"dataset-completeness-shadow"}
    once, twice = (invariants.content_hash(u.repartition(k).drop("route")).first() for k in (1, 7))
    assert once == twice


def test_zero_over_zero(spark):
    u = spark.createDataFrame([("r", "neither")], "repo_id string, bucket string")
    assert metrics.global_adoption(u).first()["value"] == 0.0 and metrics.per_repo_adoption(u).first()["value"] == 0.0


def test_pages_and_filters(spark):
    df = spark.createDataFrame([(k, f"Name{k}") for k in range(20)], "n int, name string")
    assert [r["n"] for r in tables.page(df, tables.table_sort(df, "n", True), 1, 5).collect()] == [14, 13, 12, 11, 10]
    assert tables.text_filter(df, "NAME1").count() == 11 and tables.text_filter(df, "").count() == 20


def test_strings(spark):
    rows = [("", "x", "/x"), ("/", "x", "/x"), ("/a", "", "/a"), ("", "", "/"), ("/a", "/b", "/b"), ("/a/", "b", "/a/b"), ("/a", None, "/a")]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "a string, b string, c string")
    assert all(r[0] == r[1] for r in df.select(X.join_path(F.col("a"), F.col("b")), "c").collect())
    names = spark.createDataFrame([("n", "u"), (None, "https://h/o/repo.git"), ("", "git@h:o/r2.git")], "n string, u string")
    assert [r[0] for r in names.select(X.repo_id(F.col("n"), F.col("u"))).collect()] == ["n", "repo", "r2"]
    tags = spark.createDataFrame([("div",), ("motion.div",), ("_X",), ("Card",), ("svg:path",)], "t string")
    assert [r[0] for r in tags.select(X.is_native_tag(F.col("t"))).collect()] == [True, True, False, False, True]


def test_library_overrides():
    a, b, c = (C.Library(i, p, "/x", "k") for i, p in (("one", "own"), ("one", "shared"), ("two", "shared")))
    assert [(x.lib_id, x.pattern) for x in C.effective_libraries([b, c], [a])] == [("one", "own"), ("two", "shared")]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"kind":"usage","repoId":"a","bucket":"adoption"}\n{"kind":"usage","repoId":"a","bucket":"shadow"}\n')
    q = incremental.adoption_stream(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("adoption").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (folder / "2.json").write_text('{"kind":"usage","repoId":"a","bucket":"adoption"}\n{"kind":"shadow-component","repoId":"a"}\n')
    q.processAllAvailable()
    q.stop()
    assert [(r["adoption"], r["shadow"]) for r in spark.table("adoption").collect()] == [(2, 1)]
    a, b = (spark.createDataFrame([(r, v)], "repo_id string, value double") for r, v in (("a", 0.5), ("a", 0.75)))
    assert incremental.scan_delta(a, b).first()["delta"] == 0.25


def plain(x):
    return None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "pages", "nation", "region", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    mine = queries.queries()[name](spark, sf_dir)
    other = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(mine.columns)
    rows = mine.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(repr([plain(x) for x in r]) for r in rows) == sorted(repr([plain(x) for x in r]) for r in other)


def test_queries_without_sql(spark, sf_dir):
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"o6_recommendations"}
    # one value for the same rows in any order, another for other rows
    u = adapters.usage(spark, sf_dir).drop("route")
    same, other = u.repartition(7).sort("line"), u.withColumn("line", F.col("line") + 1)
    a, b, c = (tuple(invariants.content_hash(x).first()) for x in (u, same, other))
    assert a == b == tuple(queries.queries()["i9_content_hash"](spark, sf_dir).first()) and a != c
    # parts add up: the rows of each day, digested apart
    parts = invariants.digest_limbs(u.where("line % 2 = 0")).unionByName(invariants.digest_limbs(u.where("line % 2 = 1")))
    assert tuple(invariants.merged_digest(parts).first()) == a
    assert tuple(invariants.content_hash(u.limit(0)).first()) == (0, "0-0-0-0")
    got = queries.queries()["o6_recommendations"](spark, sf_dir).orderBy("position").collect()
    ranks = [("high", "medium", "low").index(r["priority"]) for r in got]
    assert [r["position"] for r in got] == list(range(1, len(got) + 1)) and ranks == sorted(ranks) and 0 < len(got) <= 12


def test_checks_find_something(spark, sf_dir):
    for name in ("i_row_checks", "i5_completeness", "i6_single_version", "i8_route_recompute"):
        assert all(r["count"] > 0 for r in queries.queries()[name](spark, sf_dir).collect()), name
    assert queries.queries()["o5_tune"](spark, sf_dir).count() == 1


def test_whole_closures_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT l_suppkey % 5, l_partkey, l_linenumber, o_orderpriority FROM '{sf_dir}/lineitem.parquet' JOIN '{sf_dir}/orders.parquet' ON l_orderkey = o_orderkey").fetchall()
    edges, paths = {}, {}
    for repo, part, line, path in rows:
        edges.setdefault((f"r{repo}", part % 97), set()).add((part * 31 + line) % 97)
        paths.setdefault((f"r{repo}", f"f{part % 199}"), set()).add(path)
    want = set()
    for repo, root in edges:
        seen, frontier = {root}, {root}
        while frontier:
            frontier = {y for x in frontier for y in edges.get((repo, x), ())} - seen
            seen |= frontier
        want |= {(repo, root, x) for x in seen}
    assert {tuple(r) for r in queries.queries()["t7_reachable"](spark, sf_dir).select("repo_id", "root", "node").collect()} == want
    got = {(r["repo_id"], r["file"]): r for r in queries.queries()["t10_bind_files"](spark, sf_dir).collect()}
    assert set(got) == set(paths)
    for key, found in paths.items():
        assert got[key]["kind"] == ("bound" if len(found) == 1 else "shared") and (got[key]["path"] or got[key]["paths"]) == ",".join(sorted(found))


def test_whole_dataset_order(spark, sf_dir):
    got = [tuple(r) for r in queries.queries()["o1_dataset_order"](spark, sf_dir).collect()]
    assert len(got) == adapters.usage(spark, sf_dir).count() > 500 and got == sorted(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
    random.seed(0)


def test_literal_starts(spark):
    want = {"^@team/kit$": "@team/kit", r"^a\\.b[0-9]$": "a.b", "^ab?c$": "a", "^(?:a|b)c$": "", "^a|b$": "", "kit": "", "^src/(?:[^/]+/)*x$": "src/", r"^a\\+b$": "a+b"}
    df = spark.createDataFrame([(k.replace("\\\\", "\\"),) for k in want], "p string")
    assert [r[0] for r in df.select(joins.literal_start(F.col("p"))).collect()] == list(want.values())


def test_ordered_lines(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("é "), F.lpad(F.col("id") * 7 % 5000, 5, "0")).alias("value"))
    ordered = df.orderBy("value")
    sinks.write_single_text(ordered, str(tmp_path / "all.jsonl"))
    text = (tmp_path / "all.jsonl").read_text(encoding="utf-8")
    assert text == "".join(f"é {k:05d}\n" for k in range(5000))
    sinks.write_ordered(ordered.repartition(3), str(tmp_path / "parts"))
    manifest = json.loads((tmp_path / "parts/manifest.json").read_text())
    assert manifest["rows"] == 5000 and [p["offset"] for p in manifest["parts"]] == [0, *(sum(q["bytes"] for q in manifest["parts"][:k]) for k in range(1, len(manifest["parts"])))]
    with pytest.raises(Exception):
        sinks.write_ordered(df.select(F.when(F.col("value") > "é 04990", F.raise_error(F.lit("no"))).otherwise(F.col("value")).alias("value")), str(tmp_path / "failed"))
    assert not (tmp_path / "failed/manifest.json").exists()
    sinks.write_single_text(df.limit(0), str(tmp_path / "none.jsonl"))
    assert (tmp_path / "none.jsonl").read_text() == ""


def test_variants(spark):
    df = spark.createDataFrame([(x,) for x in ('{"kind": "usage", "repoId": "r", "line": 3}', "{broken", "", "  ", "[1]", '{"kind": "unresolved-dynamic"}')], "value string")
    got = [(r["kind"], r["repo_id"], r["value"][:4]) for r in records.variants(df).collect()]
    assert got == [("usage", "r", '{"ki'), (None, None, "{bro"), (None, None, "[1]"), ("unresolved-dynamic", None, '{"ki')]
    docs = spark.createDataFrame([('{"a": {"b": [{"x": 1}, {"x": "2"}, {}]}}',), ('{"a": 1}',), ("no",)], "value string")
    assert [tuple(r) for r in records.elements(docs, "$.a.b", {"x": ("$.x", "long")}).collect()] == [(0, 1), (1, 2), (2, None)]


def test_written_records_are_a_small_part_of_their_text(spark, sf_dir, tmp_path):
    # the text of all records was written as it is
    from kitmeter.plans import adapters
    from kitmeter.schema import USAGE
    from kitmeter.sources import records

    u = adapters.usage(spark, sf_dir)
    lines = records.usage_json(u.withColumns({f.name: F.lit(None).cast(f.dataType) for f in USAGE if f.name not in u.columns}))
    text = lines.agg(F.sum(F.octet_length("value"))).first()[0]
    records.write_lines(lines, str(tmp_path / "lines"))
    assert sum(x.stat().st_size for x in (tmp_path / "lines").iterdir()) < text / 5
    back = records.read_jsonl(spark, str(tmp_path / "lines"))["usage"].select("repo_id", "file_path", "line", "col", "component_name", "ds_package", "route")
    assert back.exceptAll(u.select(*back.columns)).isEmpty() and back.count() == u.count()
