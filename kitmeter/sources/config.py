"""Configuration and the repositories to scan, from JSON files on the driver."""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import dataclass, field
from typing import Any

from ..functions.expressions import glob_to_regex
from ..schema import PRIMITIVES

# Default include and exclude globs, pruned folders.
INCLUDE = ("src/**/*.{ts,tsx,js,jsx}",)
EXCLUDE = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/*.test.*", "**/*.spec.*", "**/*.stories.*",
    "**/__mocks__/**", "**/__fixtures__/**", "**/mocks/**", "**/*.mock.*", "**/*.fixture.*",
)


class ConfigError(ValueError):
    """A missing or malformed configuration."""


@dataclass
class Library:
    lib_id: str
    pattern: str
    path: str
    kind: str


@dataclass
class Repo:
    repo_id: str
    root: str
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = ()
    tsconfig: str = "tsconfig.json"
    libraries: list[Library] = field(default_factory=list)
    routes: bool | None = None
    primitives: list[str] | None = None


@dataclass
class Config:
    ds_root: str
    output: str = "results"
    formats: tuple[str, ...] = ("jsonl", "aggregates", "html")
    reusable_files: int = 2
    substantial_elements: int = 5
    unresolved_rate: float = 0.05
    snippet_lines: int = 200
    routes: bool = True
    depth: int = 20
    min_repos: int = 5
    outreach_max: float = 0.3
    promote_ratio: float = 0.1
    most: int = 12
    primitives: list[str] = field(default_factory=lambda: list(PRIMITIVES))
    libraries: list[Library] = field(default_factory=list)
    #: The folder of the configuration file.
    base: str = "."


def _json(path: str) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    except ValueError as e:
        raise ConfigError(f"malformed JSON in {path}: {e}") from e


def _libraries(items: list[dict[str, Any]], base: str) -> list[Library]:
    try:
        return [Library(x["libId"], x["matchPattern"], os.path.abspath(os.path.join(base, x["source"]["path"])), {"partially-ds-backed": "partially-backed"}.get(x["kind"], x["kind"])) for x in items]
    except (KeyError, TypeError) as e:
        raise ConfigError(f"malformed library: {e}") from e


def _between(value: Any, low: float, high: float, name: str) -> Any:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not low <= value <= high:
        raise ConfigError(f"{name} must lie between {low} and {high}")
    return value


def load_config(path: str) -> Config:
    """The global configuration, checked, with defaults; ``dsPath`` is a checkout of the design system."""
    raw = _json(path)
    if not isinstance(raw, dict) or not isinstance(raw.get("dsPath"), str):
        raise ConfigError("dsPath is required")
    base = os.path.dirname(os.path.abspath(path))
    t, r, o, rec = (raw.get(k) or {} for k in ("thresholds", "routeResolution", "output", "recommendations"))
    d = Config(os.path.abspath(os.path.join(base, raw["dsPath"])))
    return Config(
        d.ds_root,
        os.path.abspath(os.path.join(base, o.get("dir", d.output))),
        tuple(o.get("formats", d.formats)),
        int(_between(t.get("reusableLocalFiles", d.reusable_files), 1, 1e9, "reusableLocalFiles")),
        int(_between(t.get("substantialMarkupElements", d.substantial_elements), 1, 1e9, "substantialMarkupElements")),
        _between(t.get("unresolvedDynamicWarningPct", d.unresolved_rate), 0, 1, "unresolvedDynamicWarningPct"),
        int(_between(t.get("codeSnippetMaxLines", d.snippet_lines), 1, 1e9, "codeSnippetMaxLines")),
        bool(r.get("enabled", d.routes)),
        int(_between(r.get("importGraphDepthLimit", d.depth), 1, 1e6, "importGraphDepthLimit")),
        int(_between(rec.get("minRepos", d.min_repos), 1, 1e9, "minRepos")),
        _between(rec.get("outreachMaxAdoption", d.outreach_max), 0, 1, "outreachMaxAdoption"),
        _between(rec.get("promotePackageMaxReposRatio", d.promote_ratio), 0, 1, "promotePackageMaxReposRatio"),
        int(_between(rec.get("maxRecommendations", d.most), 0, 1e9, "maxRecommendations")),
        list(raw.get("primitiveNames") or d.primitives),
        _libraries(raw.get("sharedLibraries") or [], base),
        base,
    )


def repo_name(name: str | None, url: str) -> str:
    last = re.sub(r"\.git$", "", re.split("[/:]", url.rstrip("/"))[-1])
    return name or last or url


def load_repos(path: str, cache: str = ".cache", per_repo: str = "scan.config.json") -> list[Repo]:
    """The repositories: a non-empty JSON list; settings from the repo's own file, else inline, else defaults, whole."""
    raw = _json(path)
    if not isinstance(raw, list) or not raw:
        raise ConfigError("the list of repositories is empty")
    base, out = os.path.dirname(os.path.abspath(path)), []
    for x in raw:
        if not isinstance(x, dict) or not (x.get("gitUrl") or x.get("localPath")):
            raise ConfigError("a repository needs gitUrl or localPath")
        repo_id = repo_name(x.get("name"), x.get("gitUrl") or x.get("localPath") or "")
        root = os.path.join(base, x["localPath"]) if x.get("localPath") else clone(x["gitUrl"], os.path.join(cache, repo_id))
        own = os.path.join(root, per_repo)
        c = _json(own) if os.path.exists(own) else x.get("config") or {}
        out.append(Repo(repo_id, os.path.abspath(root), tuple(c.get("include") or INCLUDE), tuple(c.get("exclude") or ()), c.get("tsconfig", "tsconfig.json"), _libraries(c.get("localLibraries") or [], root), (c.get("routeResolution") or {}).get("enabled"), c.get("primitiveNamesOverride")))
    return out


def effective_libraries(shared: list[Library], own: list[Library]) -> list[Library]:
    """A repo's own first; shared ones of the same id are replaced whole."""
    ids = {x.lib_id for x in own}
    return own + [x for x in shared if x.lib_id not in ids]


# --- git, on the driver


def git(*args: str, timeout: int) -> str:
    return subprocess.run(["git", *args], check=True, capture_output=True, text=True, timeout=timeout).stdout.strip()


def clone(url: str, target: str) -> str:
    """A shallow clone, kept: an existing checkout is used as it is."""
    if not os.path.isdir(os.path.join(target, ".git")):
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        git("clone", "--depth", "1", "--single-branch", "--", url, target, timeout=180)
    return target


def describe(root: str) -> str:
    try:
        return git("-C", root, "describe", "--tags", "--always", timeout=10)
    except (subprocess.SubprocessError, OSError):
        return "unknown"


def pull(root: str) -> bool:
    try:
        git("-C", root, "pull", "--ff-only", timeout=60)
        return True
    except (subprocess.SubprocessError, OSError):
        return False
