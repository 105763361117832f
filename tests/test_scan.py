"""The whole scan over small repositories written here."""

import json
import os

import pytest

from kitmeter.plans import scan as S
from kitmeter.schema import Vocabulary
from kitmeter.sources import config as C
from kitmeter.sources import records

DS = {
    "packages/button/package.json": '{"name": "@acme/button"}',
    "packages/button/src/index.ts": "export const Button = () => null; export type ButtonProps = {};",
    "packages/form/package.json": '{"name": "@acme/form"}',
    "packages/form/src/index.ts": "export function Form() {} export { Form as default };",
    "packages/all/package.json": '{"name": "@acme/all"}',
    "packages/all/src/index.ts": "export * from '@acme/button'; export { Form } from '@acme/form'; export const Own = 1;",
    "packages/broken/package.json": "{",
}

REPOS = {
    "pure": {
        "src/App.tsx": "import { Button } from '@acme/button';\nimport { Button as B, Form, Own } from '@acme/all';\nexport function App() {\n  return <div><Button/><B/><Form.Item/><Own/></div>;\n}\n",
    },
    "primitive": {
        "src/Button.tsx": "export function Button({ label, onClick }) { return <div><span/><i/><b/><p/>{label}</div>; }",
        "src/Card.tsx": "export const Card = ({ children }: Props) => (<section><p/><p/>{children}</section>);",
        "src/A.tsx": "import { Button } from './Button';\nimport { Card } from './Card';\nconst A = () => <Card><Button/></Card>;\nexport default A;",
        "src/B.tsx": "import { Button } from './Button';\nexport default function B() { return <><Button/><Button/></>; }",
        "src/__mocks__/M.tsx": "export const M = () => <Never/>;",
        "src/bad.tsx": "const x = <<<<",
        "src/gen.ts": "export const id = <T>(x: T): T => x;",
    },
    "wrappers": {
        "src/Plain.tsx": "import { Button } from '@acme/button';\nexport const Plain = () => <div><Button/></div>;",
        "src/Custom.tsx": "import { Button } from '@acme/button';\nexport const Custom = () => <Button className=\"x\"/>;",
        "src/Styled.tsx": "import styled from 'styled-components';\nimport { Button } from '@acme/button';\nexport const Styled = styled(Button)`color: red;`;",
        "src/use.tsx": "import { Plain } from './Plain';\nimport { Custom } from './Custom';\nimport { Styled } from './Styled';\nimport { AuthProvider } from './auth';\nimport X from 'other';\nexport default () => <AuthProvider><Plain/><Custom/><Styled/><X/></AuthProvider>;",
        "src/auth.tsx": "export function AuthProvider() { return <a><b/><c/><d/><e/><f/></a>; }",
    },
    "barrels": {
        "tsconfig.json": '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"] }, } }',
        "src/kit/Old.tsx": "export const Old = () => <div/>;",
        "src/kit/index.ts": "export { Old } from './Old'; export { Old as Renamed } from './Old';",
        "src/index.ts": "export * from './kit';",
        "src/one.tsx": "import { Old } from '@/kit/Old';\nexport default () => <Old/>;",
        "src/two.tsx": "import { Renamed } from '@/kit';\nexport default () => <Renamed/>;",
        "src/three.tsx": "import { Old } from '@/index';\nimport * as All from '@/index';\nexport default () => <><Old/><All.Old/></>;",
    },
    "routes": {
        "src/router.tsx": "import { createBrowserRouter } from 'react-router-dom';\nimport { Guard } from 'guard';\nimport { Home } from './pages';\nimport { PATHS } from './paths';\nexport const router = createBrowserRouter([\n  { path: PATHS.home, element: <Guard><Home/></Guard>, children: [{ path: PATHS.deep.pay, lazy: () => import('./pages/Pay') }] },\n  { path: '/x', element: ok ? <Home/> : null },\n]);",
        "src/paths.ts": "export const PATHS = { home: '/', deep: { pay: 'pay' } } as const;",
        "src/pages/index.ts": "export { Home } from './Home';",
        "src/pages/Home.tsx": "import { Header } from '../Header';\nimport { Button } from '@acme/button';\nexport const Home = () => <div><Header/><Button/></div>;",
        "src/pages/Pay.tsx": "import { Header } from '../Header';\nimport { Button } from '@acme/button';\nexport default function Pay() { return <div><Header/><Button/></div>; }",
        "src/Header.tsx": "export const Header = () => <header/>;",
        "src/Unused.tsx": "export const Unused = () => <p/>;",
    },
    "library": {
        "src/app.tsx": "import { Good, Bad } from '@team/kit';\nimport { Gone } from '@team/none';\nexport default () => <><Good/><Bad/><Gone/></>;",
        "kit/index.ts": "export * from './Good'; export { Bad } from './Bad';",
        "kit/Good.tsx": "import { Button } from '@acme/button';\nexport const Good = () => <Button/>;",
        "kit/Bad.tsx": "export const Bad = () => <div/>;",
    },
}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")

    def put(base, files):
        for name, text in files.items():
            path = os.path.join(root, base, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)

    put("acme", DS)
    for name, files in REPOS.items():
        put(name, files)
    libraries = [{"libId": "kit", "matchPattern": "@team/kit", "source": {"type": "local-path", "path": "kit"}, "kind": "partially-backed"}, {"libId": "none", "matchPattern": "@team/none", "source": {"type": "local-path", "path": "gone"}, "kind": "fully-custom"}]
    (root / "config.json").write_text(json.dumps({"dsPath": "acme"}))
    (root / "repos.json").write_text(json.dumps([{"name": n, "gitUrl": f"https://x/{n}.git", "localPath": n, **({"config": {"localLibraries": libraries}} if n == "library" else {})} for n in REPOS]))
    found = S.run(spark, str(root / "config.json"), str(root / "repos.json"), str(root / "out"), Vocabulary("acme"))
    rows = records.read_jsonl(spark, str(root / "out" / "dataset.jsonl"), Vocabulary("acme"))
    usage = [r.asDict(True) for r in rows["usage"].collect()]
    shadow = [r.asDict(True) for r in rows["shadow"].collect()]
    return root, found, usage, shadow


def of(rows, repo, name=None):
    return [r for r in rows if r["repo_id"] == repo and (name is None or r["component_name"] == name)]


def test_direct_adoption_and_canonical_packages(world):
    _, found, usage, _ = world
    got = {(r["component_name"], r["ds_package"], r["canonicalized_via"]) for r in of(usage, "pure") if r["category"] == "ds"}
    assert got == {("Button", "@acme/button", None), ("B", "@acme/button", "@acme/all"), ("Form.Item", "@acme/form", "@acme/all"), ("Own", "@acme/all", None)}
    assert {r["value"] for r in found["metrics"]["perRepoAdoption"] if r["repoId"] == "pure"} == {1.0}
    assert all(r["route"]["kind"] == "unsupported" for r in of(usage, "pure"))


def test_shadow_primitives(world):
    _, found, usage, shadow = world
    (button,) = of(shadow, "primitive", "Button")
    assert button["shadow_level"] == "confirmed" and button["usage_count"] == 3 and button["files_used_in"] == 2
    assert button["signals"] == ["primitive-like-name", "substantial-markup", "reusable-local"] and button["prop_names"] == ["label", "onClick"]
    (card,) = of(shadow, "primitive", "Card")
    assert card["shadow_level"] == "possible" and card["signals"] == ["primitive-like-name"] and card["jsx_element_count"] == 3
    assert not of(usage, "primitive", "Never")
    codes = [w["code"] for w in found["warnings"] if w.get("repoId") == "primitive"]
    assert codes == ["parse-failed"]


def test_wrappers(world):
    _, _, usage, shadow = world
    verdict = {r["component_name"]: (r["bucket"], r["classification_source"], r["category"]) for r in of(usage, "wrappers") if r["file_path"] == "src/use.tsx"}
    assert verdict == {
        "Plain": ("adoption", "ds-composition", "local"), "Custom": ("shadow", "wraps-with-customization", "local"), "Styled": ("shadow", "wraps-with-customization", "local"),
        "AuthProvider": ("neither", "utility-heuristic", "local"), "X": ("neither", "utility-heuristic", "third-party"),
    }
    assert {r["component_name"]: r["uses_styled"] for r in of(shadow, "wrappers")} == {"Custom": False, "Styled": True}


def test_barrels_and_aliases(world):
    _, _, usage, shadow = world
    assert {r["bucket"] for r in of(usage, "barrels") if r["component_name"] in ("Old", "Renamed", "All.Old")} == {"shadow"}
    assert [(r["usage_count"], r["files_used_in"]) for r in of(shadow, "barrels", "Old")] == [(4, 3)]


def test_routes(world):
    _, found, usage, shadow = world
    kinds = {r["file_path"]: (r["route"]["kind"], r["route"]["path"], r["route"]["paths"]) for r in of(usage, "routes")}
    assert kinds["src/pages/Home.tsx"] == ("bound", "/", None) and kinds["src/pages/Pay.tsx"] == ("bound", "/pay", None)
    assert kinds["src/Header.tsx"] == ("shared", None, ["/", "/pay"]) and kinds["src/Unused.tsx"] == ("unmapped", None, None)
    assert kinds["src/router.tsx"] == ("shared", None, ["/", "/pay", "/x"])
    (header,) = of(shadow, "routes", "Header")
    assert header["signals"][-1] == "multi-route" and header["shadow_level"] == "likely" and header["usage_count"] == 2
    assert [(r["path"], r["value"]) for r in found["metrics"]["perRouteAdoption"] if r["repoId"] == "routes"] == [("/", 0.5), ("/pay", 0.5)]
    assert "page-unresolved:conditional-element" in [w["message"] for w in found["warnings"]]


def test_libraries(world):
    _, _, usage, shadow = world
    verdict = {r["component_name"]: (r["bucket"], r["category"], r["local_lib_id"]) for r in of(usage, "library") if r["file_path"] == "src/app.tsx"}
    assert verdict == {"Good": ("adoption", "local-library", "kit"), "Bad": ("shadow", "local-library", "kit"), "Gone": ("shadow", "local-library", "none")}
    assert {r["component_name"]: r["shadow_level"] for r in of(shadow, "library")} == {"Bad": "possible", "Gone": "possible"}


def test_invariants_and_identities(world):
    _, found, usage, shadow = world
    assert found["invariants"]["failed"] == 0
    assert sum(r["usage_count"] for r in shadow) == sum(r["bucket"] == "shadow" for r in usage)
    assert found["metrics"]["bucketDistribution"]["adoption"] == sum(r["bucket"] == "adoption" for r in usage)
    assert "acmeCoverage" in found["metrics"] and found["meta"]["reposScanned"] == len(REPOS)


def test_files_and_order(world, spark):
    root, found, usage, _ = world
    lines = [json.loads(x) for x in (root / "out" / "dataset.jsonl").read_text().splitlines()]
    rank = {"usage": 0, "shadow-component": 1}
    keys = [(x["repoId"], x["filePath"], rank[x["kind"]], x.get("line", 0), x.get("column", 0)) for x in lines]
    assert keys == sorted(keys) and all(x["schemaVersion"] == "1.1" for x in lines)
    first = next(x for x in lines if x["kind"] == "usage" and x["category"] == "acme")
    assert "acmePackage" in first and "shadowLevel" not in first and first["classificationSource"] == "direct-acme"
    shadow = next(x for x in lines if x["kind"] == "shadow-component")
    assert shadow["embedding"] is None and shadow["acmeCandidateMapping"]["candidatePackage"] is None
    again = S.aggregate_dataset(spark, str(root / "out" / "dataset.jsonl"), str(root / "out" / "warnings.json"), Vocabulary("acme"))
    assert again["metrics"] == json.loads((root / "out" / "aggregates.json").read_text())["metrics"]
    assert "<script>const data = {" in (root / "out" / "report.html").read_text()


def test_config_errors(tmp_path):
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "r.json").write_text("[]")
    with pytest.raises(C.ConfigError):
        C.load_config(str(tmp_path / "c.json"))
    with pytest.raises(C.ConfigError):
        C.load_repos(str(tmp_path / "r.json"))
    from kitmeter.cli import main

    assert main(["run", "--config", str(tmp_path / "c.json"), "--repositories", str(tmp_path / "r.json")]) == 2
