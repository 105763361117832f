"""Brute force for tests: module resolution and walks over exports, one repo and one name at a time."""

from __future__ import annotations

import json
import posixpath
import re
from typing import Any

#: Extensions in the order of lookup, for a file and for a folder's index.
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx")


def package_of(specifier: str) -> str:
    parts = specifier.split("/")
    return "/".join(parts[:2]) if specifier.startswith("@") else parts[0]


def strip_json(text: str) -> str:
    """JSON without comments and trailing commas."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], out, flags=re.S)


def compiler_options(text: str | None) -> tuple[str, dict[str, list[str]]]:
    """(baseUrl, paths) of a tsconfig; the repo's root and none if it is missing or malformed."""
    try:
        found: Any = json.loads(strip_json(text or "{}")).get("compilerOptions") or {}
        base = posixpath.normpath(found.get("baseUrl") or ".")
        paths = {k: [x for x in v if isinstance(x, str)] for k, v in (found.get("paths") or {}).items() if isinstance(v, list)}
    except (ValueError, AttributeError, TypeError):
        return ".", {}
    return base, paths


class Resolver:
    def __init__(self, files: set[str], base: str = ".", paths: dict[str, list[str]] | None = None):
        self.files, self.base = files, base
        # exact names first, then the longest prefix
        self.paths = sorted((paths or {}).items(), key=lambda kv: ("*" in kv[0], -len(kv[0].split("*")[0])))

    def file(self, path: str) -> str | None:
        """The file that a path without its extension means."""
        path = posixpath.normpath(path)
        if path.startswith(".."):
            return None
        path = "" if path == "." else path
        stem, ext = posixpath.splitext(path)
        swaps = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx", ".d.ts")}.get(ext, ())
        tries = [path + x for x in EXTENSIONS] + [stem + x for x in swaps] + ([path] if ext in (".ts", ".tsx", ".js", ".jsx") else [])
        tries += [posixpath.join(path, "index") + x for x in EXTENSIONS]
        return next((x for x in tries if x in self.files), None)

    def resolve(self, source: str, importer: str) -> tuple[str, str | None]:
        """(in-repo, file), (external, package) or (unresolved, None)."""
        if source.startswith(("./", "../")) or source in (".", ".."):
            found = self.file(posixpath.join(posixpath.dirname(importer), source))
            return ("in-repo", found) if found else ("unresolved", None)
        if source.startswith("/"):
            return "unresolved", None
        for pattern, targets in self.paths:
            head, star, tail = pattern.partition("*")
            if star and source.startswith(head) and source.endswith(tail) and len(source) >= len(head) + len(tail):
                middle = source[len(head) : len(source) - len(tail)]
            elif not star and source == pattern:
                middle = ""
            else:
                continue
            for target in targets:
                found = self.file(posixpath.join(self.base, target.replace("*", middle, 1)))
                if found:
                    return "in-repo", found
            break
        found = self.file(posixpath.join(self.base, source))
        return ("in-repo", found) if found else ("external", package_of(source))


def defining_file(file, symbol, named, stars, own, depth=3, hops=0, seen=()):
    """``named``: file -> [(ord, exported, local, target)]; ``stars``: file -> [(ord, target)]; ``own``: {(file, symbol)}."""
    if hops > depth or (file, symbol) in seen:
        return file, symbol
    statements = [(o, t, loc) for o, e, loc, t in named.get(file, ()) if e == symbol] + [(o, t, None) for o, t in stars.get(file, ())]
    for _, target, local in sorted(statements, key=lambda x: x[0]):
        if local is not None:
            return defining_file(target, local, named, stars, own, depth, hops + 1, (*seen, (file, symbol))) if target else (file, symbol)
        if target:
            found = defining_file(target, symbol, named, stars, own, depth, hops + 1, (*seen, (file, symbol)))
            if found[0] != target or (target, symbol) in own:
                return found
    return file, symbol
