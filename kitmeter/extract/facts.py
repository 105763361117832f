"""Facts of one file, read from its token tree: imports, exports, JSX elements,
component profiles, module references, routes and constants."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import Any

from .tree import Node, parse

CUSTOMIZATION = frozenset(("className", "style", "css"))
FACTORIES = frozenset(("createBrowserRouter", "createHashRouter", "createMemoryRouter"))
JSX_DEPTH = 5
#: Between the names of a member.
SEP = "\x1f"

_DECLARATIONS = frozenset("const let var function class async abstract enum interface type declare namespace module".split())
_STATEMENTS = _DECLARATIONS | frozenset("import export if for while return switch try throw do break continue".split())


def unquote(text: str) -> str:
    body = text[1:-1]
    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", _escape, body, flags=re.S) if "\\" in body else body


def _escape(m: re.Match[str]) -> str:
    x = m[1]
    if x[0] in "ux" and len(x) > 1:
        return chr(int(x[1:].strip("{}"), 16))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}.get(x, x)


def native(tag: str) -> bool:
    return tag[:1] == tag[:1].lower() and tag[:1] != tag[:1].upper()


def component_name(name: str) -> bool:
    return name == "default" or (name[:1] == name[:1].upper() and name[:1] != name[:1].lower())


def base(tag: str) -> str:
    return tag if tag.isalnum() else re.split("[.:]", tag, maxsplit=1)[0]


#: Names that a walk stops at.
_WALKED = FACTORIES | {"import", "styled", "const", "let", "var"}


def walk(nodes: Sequence[Node]) -> Iterator[tuple[Sequence[Node], int]]:
    """Nodes that a recogniser begins at, elements, parents and the names of ``_WALKED``, as (siblings, place): later siblings first, parents before children."""
    stack: list[tuple[Sequence[Node], int]] = [(nodes, k) for k, n in enumerate(nodes) if n.children or n.kind == "jsx" or n.text in _WALKED]
    while stack:
        at = siblings, k = stack.pop()
        yield at
        node = siblings[k]
        if node.attributes:
            values = [v for _, v in node.attributes if v is not None]
            stack += [(values, i) for i, n in enumerate(values) if n.children or n.kind == "jsx" or n.text in _WALKED]
        if below := node.children:
            stack += [(below, i) for i, n in enumerate(below) if n.children or n.kind == "jsx" or n.text in _WALKED]


def split(nodes: list[Node], *marks: str) -> list[list[Node]]:
    """Runs of nodes between separators; type arguments are not looked into."""
    out: list[list[Node]] = [[]]
    for n in nodes:
        if n.kind == "op" and n.text in marks:
            out.append([])
        else:
            out[-1].append(n)
    return out


def chain(nodes: list[Node], k: int) -> tuple[str, int]:
    """The dotted name that begins at k and the place after it; '' if there is none."""
    if k >= len(nodes) or nodes[k].kind != "ident":
        return "", k
    name = nodes[k].text
    k += 1
    while k + 1 < len(nodes) and nodes[k].text in (".", "?.") and nodes[k + 1].kind == "ident":
        name += "." + nodes[k + 1].text
        k += 2
    return name, k


def type_arguments(nodes: list[Node], k: int) -> int:
    """The place after type arguments at k, or k if there are none."""
    if k >= len(nodes) or nodes[k].text != "<":
        return k
    depth, j = 0, k
    while j < len(nodes):
        t = nodes[j].text if nodes[j].kind == "op" else ""
        depth += (t == "<") - (t == ">")
        if t in (";", "&&", "||"):
            return k
        j += 1
        if not depth:
            return j
    return k


def ends_operand(n: Node) -> bool:
    return n.kind in ("ident", "num", "str", "regex", "template", "jsx", "group")


def expression_end(nodes: list[Node], k: int) -> int:
    """The place after the expression that begins at k: a comma, a semicolon, or a line end where a statement begins."""
    start = k
    while k < len(nodes):
        n = nodes[k]
        if n.kind == "op" and n.text in (",", ";"):
            return k
        if k > start and n.newline and ends_operand(nodes[k - 1]) and n.kind in ("ident", "num", "str", "jsx") and n.text not in ("instanceof", "in", "as", "satisfies"):
            return k
        k += 1
    return k


class Facts:
    def __init__(self, source: str, jsx: bool, snippet_lines: int = 200):
        self.source, self.snippet_lines = source, snippet_lines
        self.tree = parse(source, jsx)
        self.lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self.bindings: dict[str, tuple[str, str | None, bool]] = {}
        self.profiles: list[dict[str, Any]] = []
        self.named: list[dict[str, Any]] = []
        self.stars: list[dict[str, Any]] = []
        self.own: list[str] = []
        self.local_exports: list[tuple[str, str]] = []
        self.local_orders: list[int] = []
        self.exported_constants: dict[str, int] = {}
        self.order = 0
        self.references: list[str] = []
        self.constants: dict[str, Any] = {}
        self._statements()
        self.elements: list[dict[str, Any]] = []
        self.sites: list[list[dict[str, Any]]] = []
        self._walk()

    # --- statements

    def _statements(self) -> None:
        t, k, order = self.tree, 0, 0
        while k < len(t):
            n = t[k]
            head = n.kind == "ident" and (k == 0 or t[k - 1].text not in (".", "?."))
            if head and n.text == "import" and not (k + 1 < len(t) and (t[k + 1].text in (".", "("))):
                k = self._import(k + 1)
            elif head and n.text == "export":
                order += 1
                self.order = order
                k = self._export(k + 1, order)
            elif head and n.text in ("const", "let", "var"):
                k = self._variables(k, False)
            else:
                k += 1

    def _import(self, k: int) -> int:
        t = self.tree
        default, space, specs = "", "", []
        if k < len(t) and t[k].text == "type" and k + 1 < len(t) and t[k + 1].text not in ("from", ",") and t[k + 1].kind != "str":
            k += 1
        while k < len(t) and t[k].kind != "str":
            n = t[k]
            if n.text == "=":  # import x = require('y')
                return k
            if n.text == "*" and k + 2 < len(t) and t[k + 1].text == "as":
                space = t[k + 2].text
                k += 3
                continue
            if n.kind == "group":
                specs = split(n.children, ",")
            elif n.kind == "ident" and n.text != "from":
                default = n.text
            k += 1
        if k >= len(t):
            return k
        source = unquote(t[k].text)
        self.references.append(source)
        if default:
            self.bindings[default] = (source, None, False)
        if space:
            self.bindings[space] = (source, "*", True)
        for spec in specs:
            imported, local = self._specifier(spec)
            if imported:
                self.bindings[local] = (source, imported, False)
        return k + 1

    @staticmethod
    def _specifier(spec: list[Node]) -> tuple[str, str]:
        """(left name, right name) of ``a``, ``a as b``, ``type a as b``, ``'x' as b``."""
        names = [n for n in spec if n.kind in ("ident", "str")]
        if len(names) in (2, 4) and names[0].text == "type" and names[1].text != "as":
            names = names[1:]
        if not names:
            return "", ""
        text = lambda n: unquote(n.text) if n.kind == "str" else n.text
        if len(names) >= 3 and names[1].text == "as":
            return text(names[0]), text(names[2])
        return text(names[0]), text(names[0])

    def _export(self, k: int, order: int) -> int:
        t = self.tree
        if k < len(t) and t[k].text == "type" and k + 1 < len(t) and (t[k + 1].kind == "group" or t[k + 1].text == "*"):
            k += 1
        if k >= len(t):
            return k
        n = t[k]
        if n.text == "*":
            name = t[k + 2].text if k + 2 < len(t) and t[k + 1].text == "as" else ""
            k += 3 if name else 1
            if k + 1 < len(t) and t[k].text == "from" and t[k + 1].kind == "str":
                source = unquote(t[k + 1].text)
                self.references.append(source)
                self.stars.append({"source": source, "exported": name or None, "ord": order})
                k += 2
            return k
        if n.kind == "group" and n.text == "{":
            specs = [self._specifier(s) for s in split(n.children, ",") if s]
            k += 1
            if k + 1 < len(t) and t[k].text == "from" and t[k + 1].kind == "str":
                source = unquote(t[k + 1].text)
                self.references.append(source)
                self.named += [{"source": source, "local": a, "exported": b, "ord": order} for a, b in specs if a]
                return k + 2
            kept = [x for x in specs if x[0]]
            self.local_exports += kept
            self.local_orders += [order] * len(kept)
            return k
        if n.text == "default":
            self.own.append("default")
            return self._declaration(k + 1, "default")
        return self._declaration(k, None)

    def _declaration(self, k: int, forced: str | None) -> int:
        t = self.tree
        start = k
        while k < len(t) and t[k].text in ("async", "abstract", "declare") and t[k].kind == "ident" and not (t[k].text == "async" and k + 1 < len(t) and t[k + 1].text != "function"):
            k += 1
        if k >= len(t):
            return k
        word = t[k].text if t[k].kind == "ident" else ""
        if word == "function":
            k += 1
            if k < len(t) and t[k].text == "*":
                k += 1
            name = t[k].text if k < len(t) and t[k].kind == "ident" else ""
            k += bool(name)
            if not forced and name:
                self.own.append(name)
            params, body, k = self._function(t, k)
            name = forced or name
            if body is not None and name and component_name(name):
                self._profile(name, params, [body], t[start].start, body.end)
            return k
        if word == "class":
            k += 1
            name = t[k].text if k < len(t) and t[k].kind == "ident" and t[k].text not in ("extends", "implements") else ""
            if not forced and name:
                self.own.append(name)
            while k < len(t) and not (t[k].kind == "group" and t[k].text == "{"):
                k += 1
            if k < len(t):
                name = forced or name
                if name and component_name(name):
                    self._profile(name, None, [t[k]], t[start].start, t[k].end)
                k += 1
            return k
        if word in ("const", "let", "var") and not forced:
            if word == "const" and k + 1 < len(t) and t[k + 1].text == "enum":
                self.own.append(t[k + 2].text if k + 2 < len(t) else "")
                return k + 2
            return self._variables(k, True)
        if word in ("interface", "type", "enum", "namespace", "module") and not forced and k + 1 < len(t) and t[k + 1].kind == "ident":
            self.own.append(t[k + 1].text)
            return k + 2
        return k

    @staticmethod
    def _function(t: list[Node], k: int) -> tuple[Node | None, Node | None, int]:
        """(parameters, body, place after) of a function from its type parameters or parameters on."""
        k = type_arguments(t, k)
        if k >= len(t) or t[k].kind != "group" or t[k].text != "(":
            return None, None, k
        params = t[k]
        k += 1
        while k < len(t):
            n = t[k]
            if n.kind == "group" and n.text == "{" and not (t[k - 1].kind == "op" and t[k - 1].text in (":", "|", "&", "<", ",", "=>", "?")):
                return params, n, k + 1
            if n.text == ";" or n.newline and n.text in _STATEMENTS:
                break
            k += 1
        return params, None, k

    def _variables(self, k: int, exported: bool) -> int:
        t = self.tree
        k += 1
        while k < len(t):
            start = k
            name = t[k].text if t[k].kind == "ident" else ""
            if exported and t[k].kind == "group":
                for part in split(t[k].children, ","):
                    found = [n.text for n in part if n.kind == "ident"]
                    if found:
                        self.own.append(found[-1] if any(n.text == ":" for n in part) else found[0])
            k += 1
            depth = 0
            while k < len(t) and not (t[k].kind == "op" and t[k].text in ("=", ",", ";") and not depth):
                depth += (t[k].text == "<") - (t[k].text == ">") if t[k].kind == "op" else 0
                if t[k].newline and t[k].text in _STATEMENTS:
                    break
                k += 1
            if exported and name:
                self.own.append(name)
            if k < len(t) and t[k].text == "=":
                end = expression_end(t, k + 1)
                init = t[k + 1 : end]
                if name and init:
                    if name not in self.constants:
                        self.constants[name] = constant_of(init)
                        if exported:
                            self.exported_constants[name] = self.order
                    if exported and component_name(name):
                        self._component(name, init, t[start].start, init[-1].end)
                k = end
            if k < len(t) and t[k].text == ",":
                k += 1
                continue
            break
        return k

    def _component(self, name: str, init: list[Node], start: int, end: int) -> None:
        first = init[0]
        arrow = next((i for i, n in enumerate(init) if n.kind == "op" and n.text == "=>"), -1)
        if arrow > 0 and (first.text in ("(", "async", "<") or init[arrow - 1] is first):
            k = 1 if first.text == "async" and len(init) > 1 and init[1].text != "=>" else 0
            k = type_arguments(init, k)
            params = init[k] if init[k].kind == "group" else None
            # the last top-level arrow after a typed result may belong to the result's type
            self._profile(name, params, init[arrow + 1 :], start, end)
            return
        k = 1 if first.text == "async" else 0
        if k < len(init) and init[k].text == "function":
            k += 1
            k += k < len(init) and init[k].text == "*"
            k += k < len(init) and init[k].kind == "ident"
            params, body, _ = self._function(init, k)
            if body is not None:
                self._profile(name, params, [body], start, end)
            return
        if first.kind == "ident" and first.text not in ("new", "await", "typeof", "class", "void", "yield") and calls(init) in ("call", "tagged"):
            self._profile(name, None, init, start, end)

    def _profile(self, name: str, params: Node | None, body: list[Node], start: int, end: int) -> None:
        text = self.source[start:end]
        lines = text.split("\n")
        cut = len(lines) > self.snippet_lines
        stats = self._body(body)
        self.profiles.append({"symbol": name, "prop_names": prop_names(params), "code_snippet": "\n".join(lines[: self.snippet_lines]) if cut else text, "code_snippet_truncated": cut, **stats})

    def _body(self, body: list[Node]) -> dict[str, Any]:
        tags: list[str] = []
        native_tags: set[str] = set()
        customized: set[str] = set()
        wrapped: set[str] = set()
        styled = False
        count = 0
        for siblings, k in walk(body):
            n = siblings[k]
            if n.kind == "jsx" and n.text:
                count += 1
                if native(n.text):
                    native_tags.add(n.text)
                else:
                    tags.append(n.text.split(".")[0])
                    if any(a in CUSTOMIZATION for a, _ in n.attributes):
                        customized.add(n.text.split(".")[0])
            elif n.kind == "ident" and n.text == "styled":
                after = type_arguments(siblings, k + 1)
                follows = siblings[after] if after < len(siblings) else None
                if follows is not None and follows.kind == "group" and follows.text == "(":
                    styled = True
                    name, _ = chain(follows.children, 0)
                    if name:
                        wrapped.add(name.split(".")[0])
                elif follows is not None and follows.kind == "template":
                    styled = True
                elif follows is not None and (follows.text in (".", "?.") or follows.text == "[") and not (k and siblings[k - 1].text in (".", "?.")):
                    styled = True
        return {"jsx_element_count": count, "html_tags": sorted(native_tags), "tags": sorted(set(tags)), "customized": sorted(customized), "wrapped": sorted(wrapped), "uses_styled": styled}

    # --- elements and references

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1, column from 0."""
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1]

    def _walk(self) -> None:
        """Elements, dynamic imports and route arrays, in one walk."""
        out, sites = self.elements, []
        for siblings, k in walk(self.tree):
            n = siblings[k]
            if n.kind == "jsx":
                if n.text:
                    line, col = self.place(n.start)
                    out.append({"tag": n.text, "base": base(n.text), "line": line, "col": col, "ord": len(out)})
            elif n.kind != "ident":
                continue
            elif n.text == "import":
                if k + 1 < len(siblings) and siblings[k + 1].text == "(":
                    inner = siblings[k + 1].children
                    if len(inner) == 1 and inner[0].kind == "str":
                        self.references.append(unquote(inner[0].text))
            elif n.text in FACTORIES:
                after = type_arguments(siblings, k + 1)
                if after < len(siblings) and siblings[after].text == "(" and siblings[after].kind == "group":
                    inner = siblings[after].children
                    if inner and inner[0].kind == "group" and inner[0].text == "[":
                        sites.append(inner[0])
            elif n.text in ("const", "let", "var"):
                j = k + 1
                while j < len(siblings) and siblings[j].text not in ("=", ";"):
                    j += 1
                if j + 1 < len(siblings) and siblings[j + 1].kind == "group" and siblings[j + 1].text == "[" and route_array(siblings[j + 1]):
                    sites.append(siblings[j + 1])
        self.sites = [[route(e[0]) for e in split(s.children, ",") if len(e) == 1 and e[0].kind == "group" and e[0].text == "{"] for s in sites]

    # --- rows of the relations that routes are made from

    def constant_rows(self) -> list[dict[str, Any]]:
        """A row for each constant and each property inside it: name, member, kind, text, ord."""
        out = []
        stack = [(name, "", e) for name, e in self.constants.items()]
        while stack:
            name, member, e = stack.pop()
            out.append({"name": name, "member": member, **expression(e), "ord": self.exported_constants.get(name) if not member else None})
            if e["t"] == "obj":
                stack += [(name, f"{member}{SEP}{x}" if member else x, v) for x, v in e["v"].items()]
        return out

    def route_rows(self) -> list[dict[str, Any]]:
        """A row for each node of the route arrays in order of discovery: node, parent, path (kind, text), page, names."""
        out: list[dict[str, Any]] = []
        stack = [(r, None) for site in reversed(self.sites) for r in reversed(site)]
        while stack:
            r, parent = stack.pop()
            page = r["page"]
            v = page.get("v")
            out.append({"node": len(out), "parent": parent, "path": expression(r["path"]) if r["path"] else None, "page": page["k"], "names": v if isinstance(v, list) else [v] if v else []})
            stack += [(c, len(out) - 1) for c in reversed(r["children"])]
        return out


def expression(e: dict[str, Any]) -> dict[str, Any]:
    """kind and text of a constant expression."""
    v = e.get("v")
    return {"kind": e["t"], "text": e["k"] if e["t"] == "other" else None if e["t"] == "obj" else SEP.join(v) if isinstance(v, list) else v}


def calls(nodes: list[Node]) -> str:
    """call, tagged or '' for a chain of names, members, calls and templates."""
    k, last = 1, ""
    while k < len(nodes):
        n = nodes[k]
        if n.text in (".", "?.") and k + 1 < len(nodes):
            k, last = k + 2, ""
        elif n.kind == "group" and n.text in ("(", "["):
            k, last = k + 1, "call" if n.text == "(" else ""
        elif n.kind == "template":
            k, last = k + 1, "tagged"
        elif n.text == "<" and (j := type_arguments(nodes, k)) > k:
            k = j
        else:
            return ""
    return last


def prop_names(params: Node | None) -> list[str]:
    """Names of a destructured first parameter, or of its inline type."""
    if params is None or not params.children:
        return []
    first = split(params.children, ",")[0]
    if not first:
        return []
    names: set[str] = set()
    if first[0].kind == "group" and first[0].text == "{":
        if any(n.kind == "op" and n.text == "=" for n in first):
            return []
        for part in split(first[0].children, ","):
            if part and part[0].kind == "ident":
                names.add(part[0].text)
    elif len(first) == 3 + (first[1:2] != [] and first[1].text == "?") and first[0].kind == "ident" and first[-2].text == ":" and first[-1].kind == "group" and first[-1].text == "{":
        for part in members(first[-1].children):
            k = 1 if part[0].text == "readonly" and len(part) > 1 and part[1].kind == "ident" else 0
            if part[k].kind == "ident" and (k + 1 == len(part) or part[k + 1].text in (":", "?")) and not any(n.kind == "group" and n.text == "(" and i == k + 1 for i, n in enumerate(part)):
                names.add(part[k].text)
    return sorted(names)


def members(nodes: list[Node]) -> list[list[Node]]:
    """Members of a type literal: between ; , and line ends that end a type."""
    out: list[list[Node]] = [[]]
    for k, n in enumerate(nodes):
        if n.kind == "op" and n.text in (";", ","):
            out.append([])
            continue
        if n.newline and out[-1] and n.kind == "ident" and ends_operand(nodes[k - 1]):
            out.append([])
        out[-1].append(n)
    return [m for m in out if m]


def strip(nodes: list[Node]) -> list[Node]:
    """Without ``as``, ``satisfies``, ``!`` and outer parentheses."""
    for k, n in enumerate(nodes):
        if k and n.kind == "ident" and n.text in ("as", "satisfies"):
            nodes = nodes[:k]
            break
    while nodes and nodes[-1].kind == "op" and nodes[-1].text == "!":
        nodes = nodes[:-1]
    if len(nodes) == 1 and nodes[0].kind == "group" and nodes[0].text == "(":
        return strip(nodes[0].children)
    return nodes


def constant_of(nodes: list[Node]) -> dict[str, Any]:
    """A constant expression: str, name, member, obj, or other with its kind."""
    nodes = strip(nodes)
    if len(nodes) == 1:
        n = nodes[0]
        if n.kind == "str":
            return {"t": "str", "v": unquote(n.text)}
        if n.kind == "template":
            return {"t": "other", "k": "template-literal"} if n.children else {"t": "str", "v": unquote(n.text)}
        if n.kind == "ident":
            return {"t": "name", "v": n.text}
        if n.kind == "group" and n.text == "{":
            out: dict[str, Any] = {}
            for part in split(n.children, ","):
                if len(part) >= 3 and part[1].text == ":" and part[0].kind in ("ident", "str"):
                    out[unquote(part[0].text) if part[0].kind == "str" else part[0].text] = constant_of(part[2:])
                elif len(part) == 1 and part[0].kind == "ident":
                    out[part[0].text] = {"t": "name", "v": part[0].text}
            return {"t": "obj", "v": out}
        return {"t": "other", "k": "non-string-literal" if n.kind == "num" else "unsupported"}
    name, end = chain(nodes, 0)
    if name and end == len(nodes):
        return {"t": "member", "v": name.split(".")}
    if name and end < len(nodes) and nodes[end].text == "[":
        return {"t": "other", "k": "computed"}
    if name and end < len(nodes) and nodes[end].text == "(":
        return {"t": "other", "k": "call"}
    return {"t": "other", "k": "unsupported"}


def properties(group: Node) -> list[tuple[str, list[Node]]]:
    return [(part[0].text, part[2:]) for part in split(group.children, ",") if len(part) >= 3 and part[0].kind == "ident" and part[1].text == ":"] + [(part[0].text, part) for part in split(group.children, ",") if len(part) == 1 and part[0].kind == "ident"]


def route_array(group: Node) -> bool:
    parts = [p for p in split(group.children, ",") if p]
    if not parts:
        return False
    for part in parts:
        if len(part) != 1 or part[0].kind != "group" or part[0].text != "{":
            return False
        names = {x for x, _ in properties(part[0])} | {p[0].text for p in split(part[0].children, ",") if len(p) > 1 and p[0].kind == "ident" and p[1].text == "("}
        if not names & {"path", "element", "Component", "lazy", "children"}:
            return False
    return True


def route(group: Node) -> dict[str, Any]:
    out: dict[str, Any] = {"path": None, "page": {"k": "none"}, "children": []}
    for name, value in properties(group):
        if name == "path":
            out["path"] = constant_of(value)
        elif name == "element":
            out["page"] = element_page(value)
        elif name == "Component":
            one = len(value) == 1 and value[0].kind == "ident"
            out["page"] = {"k": "name", "v": value[0].text} if one else {"k": "dynamic", "v": "non-identifier-component"}
        elif name == "lazy":
            out["page"] = lazy_page(value)
        elif name == "children" and len(value) == 1 and value[0].text == "[":
            out["children"] = [route(e[0]) for e in split(value[0].children, ",") if len(e) == 1 and e[0].kind == "group" and e[0].text == "{"]
    return out


def element_page(value: list[Node]) -> dict[str, Any]:
    while len(value) == 1 and value[0].kind == "group" and value[0].text == "(":
        value = value[0].children
    if len(value) == 1 and value[0].kind == "jsx" and value[0].text:
        names = candidates(value[0])
        return {"k": "names", "v": names} if names else {"k": "dynamic", "v": "jsx-member-or-namespace"}
    if len(value) == 1 and value[0].kind == "ident":
        return {"k": "name", "v": value[0].text}
    if any(n.kind == "op" and n.text == "?" for n in value):
        return {"k": "dynamic", "v": "conditional-element"}
    if value and calls(value) == "call":
        return {"k": "dynamic", "v": "hoc-wrapped-element"}
    return {"k": "dynamic", "v": "unknown-element-form"}


def candidates(root: Node) -> list[str]:
    """Capitalised tags, parents first, through ``{x}`` and ``{a && x}``, a few levels deep."""
    out, queue = [], [(root, 0)]
    while queue:
        node, depth = queue.pop(0)
        if depth > JSX_DEPTH:
            continue
        if ":" not in node.text and re.match("[A-Z]", node.text):
            out.append(node.text)
        for child in node.children:
            if child.kind == "jsx":
                if child.text:
                    queue.append((child, depth + 1))
            elif child.children and child.children[-1].kind == "jsx" and child.children[-1].text and (len(child.children) == 1 or child.children[-2].text in ("&&", "||", "??")):
                queue.append((child.children[-1], depth + 1))
    return out


def lazy_page(value: list[Node]) -> dict[str, Any]:
    arrow = next((k for k, n in enumerate(value) if n.text == "=>"), -1)
    body = value[arrow + 1 :] if arrow >= 0 else [n for n in value[-1:] if value[0].text in ("function", "async")]
    if not body:
        return {"k": "dynamic", "v": "non-function-lazy"}
    if len(body) == 1 and body[0].text == "{":
        inner = body[0].children
        at = next((k for k, n in enumerate(inner) if n.text == "return"), -1)
        body = inner[at + 1 :] if at >= 0 else []
    if body and body[0].text == "await":
        body = body[1:]
    if len(body) < 2 or body[0].text != "import" or body[1].text != "(" or any(n.text != ";" for n in body[2:]):
        return {"k": "dynamic", "v": "no-import-in-lazy"}
    inner = body[1].children
    if len(inner) != 1 or inner[0].kind != "str":
        return {"k": "dynamic", "v": "dynamic-import-source"}
    return {"k": "lazy", "v": unquote(inner[0].text)}
