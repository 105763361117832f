"""Token trees of JavaScript and TypeScript, with JSX.

A file is cut into tokens; brackets, templates and JSX elements become nodes with
children. The reader knows strings, nested templates, comments, regular
expressions, JSX text and attributes, and tells generics from JSX. It does not
build expressions: the recognisers in ``facts`` read patterns of siblings.
Anything it can't balance is a SyntaxError, never a partial tree.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(slots=True, eq=False)
class Node:
    kind: str  # ident, num, str, op, regex, group, template, jsx
    text: str  # the token; of a group its opening bracket, of a JSX element its tag
    start: int
    end: int
    children: Sequence[Node] = ()
    newline: bool = False  # a line ends before it
    attributes: Sequence[tuple[str, Node | None]] = ()
    spread: bool = False


_SPACE = re.compile(r"(?:[\s\ufeff]|//[^\n]*|/\*.*?\*/)*", re.S)
_IDENT = re.compile(r"[#A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_OP = re.compile(r"=>|\?\.(?!\d)|\.\.\.|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^]=|[-+*/%&|^~!?:;,.=<>@\\]")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff-]*(?:(?:\s*[.:]\s*)[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff-]*)*")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Characters that no space or comment begins with, that begin names, that are operators alone, and that begin only operators.
_SOLID = frozenset(map(chr, range(33, 127))) - {"/"}
_LETTER = frozenset("#$_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SINGLE = frozenset(",;:")
_OPERATOR = frozenset("=>?&|!+-*%^~@\\")
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\(?:\r\n|.))*{q}", re.S) for q in "'\""}
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
_MARK = re.compile(r"[<{]")
_CLOSING = re.compile(r"<\s*/\s*")
_TEMPLATE = re.compile(r"[\\`]|\$\{")
_BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends export".split())


class Reader:
    def __init__(self, source: str, jsx: bool):
        self.s, self.jsx, self.at = source, jsx, 0

    def fail(self, what: str) -> None:
        line = self.s.count("\n", 0, self.at) + 1
        raise SyntaxError(f"{what} in line {line}")

    def program(self) -> list[Node]:
        if self.s.startswith("#!"):
            self.at = self.s.find("\n") if "\n" in self.s else len(self.s)
        return self.sequence("")

    def sequence(self, close: str) -> list[Node]:
        out: list[Node] = []
        s, end = self.s, len(self.s)
        while True:
            at = self.at
            newline = False
            if at < end and s[at] not in _SOLID:
                self.at = _SPACE.match(s, at).end()
                newline = s.find("\n", at, self.at) >= 0
                at = self.at
            if at >= end:
                if close:
                    self.fail(f"missing {close}")
                return out
            c = s[at]
            if c == close:
                self.at = at + 1
                return out
            if c in _LETTER:
                m = _IDENT.match(s, at)
                self.at = m.end()
                out.append(Node("ident", m[0], at, self.at, (), newline))
            elif c in _SINGLE:
                self.at = at + 1
                out.append(Node("op", c, at, self.at, (), newline))
            else:
                node = self.token(out)
                node.newline = newline
                out.append(node)

    def operand(self, out: list[Node]) -> bool:
        """Whether the last token ends an operand, so < and / are operators."""
        if not out:
            return False
        last = out[-1]
        if last.kind == "ident":
            return last.text not in _BEFORE_EXPRESSION or (len(out) > 1 and out[-2].text in (".", "?."))
        if last.kind == "group":
            return not self.ends_statement_part(out)
        return last.kind in ("num", "str", "regex", "template", "jsx") or last.text in ("++", "--") or last.text == "!" and self.operand(out[:-1])

    @staticmethod
    def ends_statement_part(out: list[Node]) -> bool:
        """Whether the last group is the head of a statement, if (..), or the block of one, so that an expression may begin after it."""
        heads = ("if", "while", "for", "with", "switch", "catch")
        word = lambda k: out[k].text if len(out) >= -k and out[k].kind == "ident" and not (len(out) > -k and out[k - 1].text in (".", "?.")) else ""
        if out[-1].text == "(":
            return word(-2) in heads or word(-2) == "await" and word(-3) == "for"
        if out[-1].text != "{":
            return False
        if word(-2) in ("else", "do", "try", "finally"):
            return True
        if len(out) > 2 and out[-2].kind == "group" and out[-2].text == "(":
            # if (..) {..}, or a function declaration that begins a statement
            if word(-3) in heads:
                return True
            name = -4 if word(-3) != "function" else -3
            start = name - 1 if word(name - 1) == "async" else name
            before = out[start - 1] if len(out) >= 1 - start else None
            return word(name) == "function" and (before is None or before.text in (";", "{") or before.kind == "group" and before.text == "{")
        return len(out) == 1 or out[-2].text == ";"

    def token(self, out: list[Node]) -> Node:
        s, at = self.s, self.at
        c = s[at]
        if c in _CLOSE:
            self.at += 1
            children = self.sequence(_CLOSE[c])
            return Node("group", c, at, self.at, children)
        if c in ")]}":
            self.fail(f"unexpected {c}")
        if c in "'\"":
            return self.string(c)
        if c == "`":
            return self.template()
        if c in _OPERATOR:
            self.at = _OP.match(s, at).end()
            return Node("op", s[at : self.at], at, self.at)
        m = _IDENT.match(s, at)
        if m:
            self.at = m.end()
            return Node("ident", m[0], at, self.at)
        m = _NUMBER.match(s, at)
        if m:
            self.at = m.end()
            return Node("num", m[0], at, self.at)
        if c == "<" and not self.operand(out):
            if s.startswith("<<", at):
                self.fail("unexpected <<")
            if self.jsx and not _GENERIC.match(s, at):
                return self.element()
        if c == "/" and not self.operand(out):
            m = _REGEX.match(s, at)
            if not m:
                self.fail("bad regular expression")
            self.at = m.end()
            return Node("regex", m[0], at, self.at)
        m = _OP.match(s, at)
        if not m:
            self.fail(f"unexpected {c!r}")
        self.at = m.end()
        return Node("op", m[0], at, self.at)

    def string(self, quote: str) -> Node:
        at = self.at
        m = _STRING[quote].match(self.s, at)
        if not m:
            self.fail("unterminated string")
        self.at = m.end()
        return Node("str", m[0], at, self.at)

    def template(self) -> Node:
        s, at = self.s, self.at
        node = Node("template", "`", at, at, [])
        self.at += 1
        while True:
            m = _TEMPLATE.search(s, self.at)
            if not m:
                self.at = len(s)
                self.fail("unterminated template")
            self.at = m.end()
            if m[0] == "\\":
                self.at += 1
            elif m[0] == "`":
                node.end = self.at
                node.text = s[at : self.at]
                return node
            else:
                start = self.at - 1
                node.children.append(Node("group", "{", start, start, self.sequence("}")))
                node.children[-1].end = self.at

    def name(self) -> str:
        m = _JSX_NAME.match(self.s, self.at)
        if not m:
            return ""
        self.at = m.end()
        return m[0] if m[0].isalnum() else re.sub(r"\s+", "", m[0])

    def space(self) -> None:
        if self.s[self.at : self.at + 1] not in _SOLID:
            self.at = _SPACE.match(self.s, self.at).end()

    def element(self) -> Node:
        s, start = self.s, self.at
        self.at += 1
        self.space()
        tag = self.name()
        node = Node("jsx", tag, start, start, [], False, [])
        self.space()
        if tag and s.startswith("<", self.at):  # type arguments of the component
            depth = 0
            while self.at < len(s):
                depth += {"<": 1, ">": -1}.get(s[self.at], 0)
                self.at += 1
                if not depth:
                    break
        while True:
            self.space()
            if self.at >= len(s):
                self.fail("unterminated element")
            if s.startswith("/>", self.at) and tag:
                self.at += 2
                node.end = self.at
                return node
            c = s[self.at]
            if c == ">":
                self.at += 1
                break
            if not tag:
                self.fail("bad fragment")
            if c == "{":
                self.at += 1
                at = self.at
                node.spread = True
                node.attributes.append(("...", Node("group", "{", at, at, self.sequence("}"))))
                continue
            name = self.name()
            if not name:
                self.fail("bad attribute")
            self.space()
            value: Node | None = None
            if s.startswith("=", self.at):
                self.at += 1
                self.space()
                value = self.value()
            node.attributes.append((name, value))
        self.content(node)
        return node

    def value(self) -> Node:
        s, at = self.s, self.at
        c = s[at : at + 1]
        if c in ("'", '"') and c:
            end = s.find(c, at + 1)
            if end < 0:
                self.fail("unterminated attribute")
            self.at = end + 1
            return Node("str", s[at : self.at], at, self.at)
        if c == "{":
            self.at += 1
            return Node("group", "{", at, at, self.sequence("}"))
        if c == "<":
            return self.element()
        self.fail("bad attribute value")
        raise AssertionError

    def content(self, node: Node) -> None:
        s = self.s
        while True:
            m = _MARK.search(s, self.at)
            if not m:
                self.fail(f"unclosed element {node.text}")
            self.at = m.start()
            if m[0] == "{":
                at = self.at
                self.at += 1
                node.children.append(Node("group", "{", at, at, self.sequence("}")))
                node.children[-1].end = self.at
                continue
            closing = _CLOSING.match(s, self.at)
            if closing:
                self.at = closing.end()
                tag = self.name()
                self.space()
                if tag != node.text or not s.startswith(">", self.at):
                    self.fail(f"element {node.text} closed by {tag}")
                self.at += 1
                node.end = self.at
                return
            node.children.append(self.element())


def parse(source: str, jsx: bool) -> list[Node]:
    """The tokens and nodes of a file in order."""
    return Reader(source, jsx).program()
