"""Module resolution, walks over exports, source trees and prescans."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kitmeter.operators import modules, routes, trace
from kitmeter.plans import facts, prescan
from kitmeter.sources import files
from kitmeter.sources.config import Library

from .brute import Resolver, compiler_options, defining_file, package_of


def test_brute_resolver():
    files = {"src/a.ts", "src/b/index.tsx", "src/c.d.ts", "src/d.js", "lib/e.ts"}
    base, paths = compiler_options('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/b/*": ["lib/*"], "exact": ["lib/e"],}}} // end')
    r = Resolver(files, base, paths)
    assert r.resolve("./a", "src/x.ts") == ("in-repo", "src/a.ts") and r.resolve("./b", "src/x.ts") == ("in-repo", "src/b/index.tsx")
    assert r.resolve("./a.js", "src/x.ts") == ("in-repo", "src/a.ts") and r.resolve("./no", "src/x.ts") == ("unresolved", None)
    assert r.resolve("@/a", "x.ts") == ("in-repo", "src/a.ts") and r.resolve("@/b/e", "x.ts") == ("in-repo", "lib/e.ts") and r.resolve("exact", "x.ts") == ("in-repo", "lib/e.ts")
    assert r.resolve("src/d", "x.ts") == ("in-repo", "src/d.js") and r.resolve("@s/p/x", "x.ts") == ("external", "@s/p") and r.resolve("../../out", "src/x.ts") == ("unresolved", None)
    assert [package_of(x) for x in ("@s/p/x", "p/x", "p", "@s")] == ["@s/p", "p", "p", "@s"]
    assert compiler_options("{ broken") == (".", {})


TSCONFIGS = {
    "a": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/b/*": ["lib/*", "src/c/*"], "exact": ["lib/e"], "*-kit": ["src/a/*"],}}} // end',
    "b": '{"compilerOptions": {"baseUrl": "src"}}',
    "c": "{ broken",
    "d": None,
}


def test_resolution_by_brute_force(spark):
    rng = random.Random(4)
    names = ["a", "b", "e", "index", "x.test", ".env"]
    specs = ["./a", "./b", "./b/", "../a", "../lib/e", "./a.js", "./b.jsx", ".", "..", "@/a", "@/b/e", "@/b", "exact", "a-kit", "src/a", "a/b", "@s/p/x", "react", "/root", "../../../out", "./a.ts", "./.env", "@/c/b.js"]
    listing, wanted, want = [], [], []
    for repo, config in TSCONFIGS.items():
        own = {f"{rng.choice(['', 'src/', 'src/a/', 'src/c/', 'lib/', 'src/b/'])}{rng.choice(names)}{rng.choice(['.ts', '.tsx', '.d.ts', '.js', '.jsx', '.css', ''])}" for _ in range(40)}
        listing += [(repo, p) for p in own]
        r = Resolver(own, *compiler_options(config))
        for file in ("src/x.ts", "src/a/y.tsx", "top.ts"):
            for s in specs:
                wanted.append((repo, file, s))
                kind, target = r.resolve(s, file)
                want.append((repo, file, s, kind, target))
    df = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = modules.resolve(df(wanted, "repo_id string, file string, source string"), df(listing, "repo_id string, path string"), df([(r, "", t) for r, t in TSCONFIGS.items()], "repo_id string, folder string, tsconfig string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[3] == "in-repo" for w in want) > 60
    assert package_of("@s/p/x") == "@s/p"


@pytest.mark.parametrize("seed", [1, 2])
def test_defining_files_by_brute_force(spark, seed):
    rng = random.Random(seed)
    names, symbols = [f"f{k}" for k in range(14)], ["A", "B", "C"]
    named, stars, own = {}, {}, {(rng.choice(names), rng.choice(symbols)) for _ in range(10)}
    for f in names:
        orders = iter(rng.sample(range(1, 100), 8))
        named[f] = [(next(orders), rng.choice(symbols), rng.choice(symbols), rng.choice([*names, None, "gone"])) for _ in range(rng.choice([0, 1, 2]))]
        stars[f] = [(next(orders), rng.choice([*names, None])) for _ in range(rng.choice([0, 1, 2, 3]))]
    wanted = [(f, s) for f in [*names, "gone"] for s in symbols]
    df = lambda rows, kinds: spark.createDataFrame([("r", *x) for x in rows], "repo_id string, " + kinds)
    got = trace.defining_file(
        df(wanted, "file string, symbol string"),
        df([(f, e, loc, t, o) for f, v in named.items() for o, e, loc, t in v], "file string, exported string, local string, target string, ord int"),
        df([(f, t, o) for f, v in stars.items() for o, t in v], "file string, target string, ord int"),
        df(list(own), "file string, symbol string"),
    )
    want = {(f, s): defining_file(f, s, named, stars, own) for f, s in wanted}
    assert {(r["file"], r["symbol"]): (r["def_file"], r["def_symbol"]) for r in got.collect()} == want
    assert sum(v[0] != k[0] for k, v in want.items()) > 5


def test_deep_route_trees(spark):
    """A chain of nodes far deeper than the rounds of joins."""
    rows = [("r", "f", k, k - 1 if k else None, f"s{k}") for k in range(200)]
    paths = {r["node"]: r["path"] for r in routes.tree_paths(spark.createDataFrame(rows, "repo_id string, file string, node int, parent int, segment string")).collect()}
    assert paths[0] == "/s0" and paths[199] == "/" + "/".join(f"s{k}" for k in range(200)) and len(paths) == 200


def put(root, tree):
    for name, text in tree.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def test_source_trees(spark, tmp_path):
    put(tmp_path, {"a/src/x.ts": "1", "a/src/deep/y.ts": "é", "a/src/_app.ts": "2", "a/src/z.css": "no", "a/top.ts": "3", "a/node_modules/m.ts": "no", "a/src/dist/d.ts": "no", "b/k.ts": "4"})
    trees = [{"tree": n, "root": str(tmp_path / n), "include": [r"\.ts$"], "exclude": ["^top"]} for n in ("a", "b", "missing")] + [{"tree": "bad", "root": "nowhere://x", "include": [""]}]
    got = files.read(spark, trees)
    assert got.rdd.getNumPartitions() == 5
    rows = {(r["tree"], r["path"]): r["content"] for r in got.where("path IS NOT NULL").collect()}
    assert rows == {("a", "src/x.ts"): "1", ("a", "src/deep/y.ts"): "é", ("a", "src/_app.ts"): "2", ("a", "src/z.css"): None, ("a", "top.ts"): None, ("b", "k.ts"): "4"}
    assert [r["tree"] for r in got.where("message IS NOT NULL").collect()] == ["bad"]
    assert all(r["content"] is None for r in files.read(spark, trees, content=False).collect())
    only = files.read(spark, [{"tree": "a", "root": str(tmp_path / "a"), "only": ["src/x.ts", "gone.ts"]}]).collect()
    assert [(r["path"], r["content"]) for r in only] == [("src/x.ts", "1")]
    assert files.read(spark, []).collect() == []


def test_deeply_nested_sources(spark):
    deep = {"p.tsx": "export const x = " + "(" * 5000 + "1" + ")" * 5000 + ";", "e.tsx": "export const A = () => " + "<b>" * 5000 + "x" + "</b>" * 5000 + ";"}
    got = {r["file"]: r for r in facts.facts_of(spark.createDataFrame([("r", k, v) for k, v in deep.items()], "repo_id string, file string, source string")).select("file", "code", "own", F.size("elements").alias("n")).collect()}
    assert got["p.tsx"]["code"] is None and got["p.tsx"]["own"] == ["x"] and got["e.tsx"]["n"] == 5000


def test_an_expression_is_walked_once_for_each_file(spark, sf_dir, monkeypatch):
    # walks were begun for each id, and grew with the table
    walked, sizes = trace._walked, []

    def counted(wanted, *rest):
        sizes.append(wanted.count())
        return walked(wanted, *rest)

    monkeypatch.setattr(trace, "_walked", counted)
    row = "repo_id string, file string, "
    wanted = [(k, "r", "f", kind, text) for k, (kind, text) in enumerate([("name", "A"), ("str", "/x"), ("obj", None), ("name", "B")] * 25)]
    made = [
        spark.createDataFrame(wanted, f"id int, {row}kind string, text string"),
        spark.createDataFrame([("r", "f", "A", "", "str", "/a", None)], f"{row}name string, member string, kind string, text string, ord int"),
        spark.createDataFrame([], f"{row}local string, source string, imported string, target string"),
        spark.createDataFrame([], f"{row}exported string, local string, ord int"),
        spark.createDataFrame([], f"{row}target string, ord int"),
        spark.createDataFrame([("r", "f")], "repo_id string, file string"),
    ]
    got = sorted((r["id"], r["value"], r["warning"]) for r in trace.constants(*made).collect())
    each = [("/a", None), ("/x", None), (None, "dynamic-path-unsupported"), (None, "dynamic-path-binding-not-found")]
    assert sizes == [4] and got == [(k, *each[k % 4]) for k in range(100)]


def test_sources_of_queries_are_dealt_over_all_cores(spark, sf_dir):
    # F1 to F4: a small table of parts is one partition, and parsing went on one core
    from pyspark.sql import functions as F

    from kitmeter.plans import relations

    sources = relations._sources(spark, sf_dir)
    used = sources.groupBy(F.spark_partition_id().alias("k")).agg(F.count("*").alias("n")).collect()
    assert len(used) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in used) < sources.count() / 2
    whole, part = facts.facts_of(sources.limit(5)), facts.facts_of(sources.limit(5), only=("file", "elements"))
    assert part.columns == ["file", "elements"] and sorted(part.collect()) == sorted(whole.select("file", "elements").collect())


def test_walks_meet_what_recognisers_begin_at():
    from kitmeter.extract.facts import Facts

    x = Facts("const a = `${<A.b c={<i/>} {...{d: import('x')}}>{e ? <></> : <j/>}</A.b>}`;\nlet r = [{ path: '/', element: <P/> }];\nexport const S = styled(B)`${1}`;", True)
    assert [e["tag"] for e in x.elements] == ["P", "A.b", "j", "i"] and [(e["line"], e["col"]) for e in x.elements] == [(2, 31), (1, 13), (1, 62), (1, 21)]
    assert x.references == ["x"] and len(x.sites) == 1 and x.profiles[0]["uses_styled"] and x.profiles[0]["wrapped"] == ["B"]


def test_libraries_with_aliases_and_failures(spark, tmp_path):
    put(tmp_path, {
        "repo/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["kit/*"]}}}',
        "repo/kit/index.ts": "export { Good } from '@/parts'; export * from '@/more'; export { gone } from './gone';",
        "repo/kit/parts/index.ts": "export { Deep as Good } from '@/deep';",
        "repo/kit/deep.tsx": "import { Button } from '@acme/button';\nexport const Deep = () => <Button/>;",
        "repo/kit/more.tsx": "export const Plain = () => <div/>; export default 1;",
        "repo/kit/build/x.tsx": "import '@acme/button'; export const Built = 1;",
        "out/lib/a.tsx": "import { Button } from '@acme/button'; export function Out() {} export { Far } from './b';",
        "out/lib/b.tsx": "export const Far = 1;",
    })
    at = lambda path, scope: prescan.place(Library("x", "x", str(path), "fully-custom"), str(scope), "tsconfig.json")
    inside, outside, bad = at(tmp_path / "repo/kit", tmp_path / "repo"), at(tmp_path / "out/lib", tmp_path / "repo"), prescan.Place("nowhere://x", str(tmp_path), "tsconfig.json")
    packages = spark.createDataFrame([("@acme/button",)], "package string")
    backed, failed = prescan.backing(spark, [inside, outside, bad], packages)
    got = {(r["key"], r["symbol"]): r["backed"] for r in backed.collect()}
    assert {s: b for (k, s), b in got.items() if k == inside.key} == {"Good": True, "Deep": True, "Plain": False, "default": False}
    assert {s: b for (k, s), b in got.items() if k == outside.key} == {"Out": True, "Far": False}
    assert [r["key"] for r in failed.collect()] == [bad.key]


def test_packages_through_six_others(spark, tmp_path):
    put(tmp_path, {f"packages/p{k}/package.json": f'{{"name": "@acme/p{k}"}}' for k in range(9)})
    put(tmp_path, {f"packages/p{k}/src/index.ts": f"export {{ Deep }} from '@acme/p{k + 1}';" for k in range(8)})
    put(tmp_path, {"packages/p8/index.ts": "export const Deep = 1;", "packages/p8/src/index.js": "export const Later = 1;"})
    found = prescan.registry(spark, str(tmp_path))
    got = {r["pkg"]: (r["source_pkg"], r["hops"]) for r in found.reexports.where("symbol = 'Deep'").collect()}
    assert found.packages.count() == 9
    assert got == {f"@acme/p{k}": ("@acme/p8", 8 - k) for k in range(2, 9)}
    with pytest.raises(FileNotFoundError):
        prescan.registry(spark, str(tmp_path / "packages"))
