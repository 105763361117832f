"""HTML main text by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into blocks: runs of text between block-level tags, with the
tags and class names of their ancestors. Tags, attributes and comments are told apart by
the states of the HTML standard, so no stray quote or slash takes text with it. The two labels (article or not) of the
blocks of a page form a chain; features are ancestor tags, words of class and id
names, the block's own tag, and counts of its text. Weights are fitted by
penalised maximum likelihood (forward-backward gradients, Adam) on labelled pages
built in ``htmlpages``; the labels of a page are decoded by Viterbi.

Pages are independent: one map over the table, no shuffle. The model, of fixed
size, is fitted on the driver and sent along.

Defined cases: null or empty html, or a page without an article block: empty
text, 0 characters; unclosed tags end with their parent or the page; an open
comment, script or tag at the end of the page takes the rest, as the standard says; repeated rows each
get their row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, htmlpages

TRAINING_PAGES = 400
EPOCHS = 240
RATE = 0.12
PENALTY = 0.0005

#: An attribute by the states of the HTML standard: a name, then perhaps = and a quoted or an unquoted
#: value, which may hold quotes and slashes. Nothing that is taken is given back.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+)?+"""
_TOKEN = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_MARK = re.compile(_ATTRIBUTE)
_NAMED = frozenset(("class", "id", "role"))
_PART = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose content is no text of the page, up to the closing tag.
_RAW = frozenset("script style noscript noembed noframes template title textarea iframe select desc metadata annotation annotation-xml".split())
_FOREIGN = frozenset(("svg", "math"))
_BLOCK = frozenset("html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article header footer nav aside main form fieldset legend label button blockquote pre figure figcaption hr address details summary center dialog menu option".split())
#: A tag that ends an open one of these, down to the nearest of those.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
_P = (frozenset(("p",)), frozenset("td th li dd div section article header footer nav aside main form blockquote figure button body".split()))
_NO_P = _BLOCK - frozenset(("html", "head", "body", "label", "button", "td", "th", "tr", "option", "legend", "summary", "figcaption"))

#: Words of names that tell something.
_LEXICON = frozenset(p for names in htmlpages.NAMES.values() for x in names for p in _PART.findall(x)) | frozenset("advertising commentary dialog hidden consent crumbs author byline body teaser toolbar navigation complementary contentinfo banner hero summary paragraph reply feedback login subscription toc".split())


class Block(NamedTuple):
    text: str
    tag: str
    marks: frozenset[str]
    linked: int


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    # places in the stack: of each tag, and of all blocks; foreign elements are counted
    open_at: dict[str, list[int]] = {}
    block_at: list[int] = []
    pieces: list[str] = []
    linked = anchors = foreigners = 0

    def last(tags: Iterable[str]) -> int:
        """The place of the innermost open element of these, 0 if there is none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            # a character reference does not reach over a tag
            text = " ".join("".join(map(html.unescape, pieces)).split())
            if text:
                tag = stack[block_at[-1]][0] if block_at else ""
                out.append(Block(text, tag, stack[-1][1], linked))
            pieces = []
        linked = 0

    def drop(k: int) -> None:
        nonlocal anchors, foreigners
        while len(stack) > k:
            t, _ = stack.pop()
            open_at[t].pop()
            anchors -= t == "a"
            foreigners -= t in _FOREIGN
            if t in _BLOCK:
                block_at.pop()

    def end_open(closing: tuple[frozenset[str], frozenset[str]]) -> None:
        k = last(closing[0])
        if k > last(closing[1]):
            drop(k)

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            pieces.append(page[pos:])
            linked += (size - pos) * (anchors > 0)
            break
        if m.start() > pos:
            pieces.append(page[pos : m.start()])
            linked += (m.start() - pos) * (anchors > 0)
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            k = last((tag,))
            if k:
                drop(k)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        foreign = foreigners > 0 or tag in _FOREIGN
        closed = foreign and m[3].endswith("/")  # elsewhere the slash has no meaning
        if tag in _RAW:
            if not closed:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = close.end() if close else size
            continue
        if tag in _BLOCK:
            flush()
            if tag in _NO_P:
                end_open(_P)
            if tag in _CLOSES:
                end_open(_CLOSES[tag])
        if tag in _VOID or closed:
            continue
        above = stack[-1][1]
        own = {f"in:{tag}"} if tag in _BLOCK else set()
        if m[3]:
            for name, *values in _MARK.findall(m[3]):
                name, value = name.lower(), "".join(values).lower()
                if name == "style":
                    if "display:none" in value.replace(" ", ""):
                        own.add("name:hidden")
                elif name in ("hidden", "aria-hidden"):
                    if value != "false":
                        own.add("name:hidden")
                elif name in _NAMED:
                    own.update(f"name:{p}" for p in _PART.findall(value) if p in _LEXICON)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            block_at.append(len(stack))
        stack.append((tag, above if own <= above else above | own))
        anchors += tag == "a"
        foreigners += tag in _FOREIGN
    flush()
    return out


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def inside(found: list[Block]) -> list[str]:
    """For each block, whether it stands in an article element, in a main one, or outside on a page that has one."""
    kinds = [next((x for x in ("in:article", "in:main") if x in b.marks), "") for b in found]
    most = max(kinds, key=("", "in:main", "in:article").index, default="")
    return [f"article:{most}:{x}" for x in kinds]


def features(b: Block, k: int, place: str) -> list[str]:
    words = b.text.count(" ") + 1
    length = len(b.text)
    links = min(1.0, b.linked / length)
    stops = sum(map(b.text.count, ".!?"))
    return [
        "bias",
        place,
        *b.marks,
        f"tag:{b.tag}",
        f"words:{_level(words, (2, 4, 7, 12, 20, 40, 80))}",
        f"links:{_level(links, (0.05, 0.3, 0.6, 0.9))}",
        f"stops:{_level(stops, (1, 2, 4))}",
        f"ends:{b.text[-1] in '.!?:'}",
        f"sign:{'©' in b.text}",
        f"digits:{sum(map(b.text.count, '0123456789')) > 0.2 * length}",
        f"tag:{b.tag}/words:{_level(words, (4, 12))}",
        f"first:{k < 2}",
    ]


class Model(NamedTuple):
    weights: dict[str, float]
    transitions: np.ndarray


def expectations(unary: np.ndarray, mask: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By forward and backward sums: the probability of label 1 of each block, and the expected number of each transition, of chains (masked where they
    have ended) with these scores of labels and transitions."""
    n, t, _ = unary.shape
    pair = mask[:, 1:] & mask[:, :-1]
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = unary[:, 0]
    for k in range(1, t):
        s = np.logaddexp(forward[:, k - 1, 0, None] + a[0], forward[:, k - 1, 1, None] + a[1]) + unary[:, k]
        forward[:, k] = np.where(mask[:, k, None], s, forward[:, k - 1])
    for k in range(t - 2, -1, -1):
        nxt = unary[:, k + 1] + backward[:, k + 1]
        s = np.logaddexp(a[:, 0] + nxt[:, 0, None], a[:, 1] + nxt[:, 1, None])
        backward[:, k] = np.where(mask[:, k + 1, None], s, 0)
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    p = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None])
    both = forward[:, :-1, :, None] + a + (unary + backward)[:, 1:, None, :] - z[:, None, None, None]
    expected = np.exp(both)[pair].sum(axis=0)
    return p, expected


def train(labelled: list[tuple[str, list[bool]]], epochs: int = EPOCHS) -> Model:
    """Fit to pages with a label for each block; pages are padded into one batch."""
    index: dict[str, int] = {}
    chains = []
    for page, labels in labelled:
        found = blocks(page)
        if len(found) != len(labels) or not found:
            raise ValueError("a label for each block is needed")
        chains.append(([[index.setdefault(f, len(index)) for f in features(b, k, x)] for k, (b, x) in enumerate(zip(found, inside(found)))], labels))
    n, t = len(chains), max(len(y) for _, y in chains)
    y = np.zeros((n, t), int)
    mask = np.zeros((n, t), bool)
    row, column = [], []
    for i, (x, labels) in enumerate(chains):
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = True
        for k, f in enumerate(x):
            row += [i * t + k] * len(f)
            column += f
    row, column = np.array(row), np.array(column)
    w, a = np.zeros(len(index)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    pair = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    for step in range(1, epochs + 1):
        unary = np.zeros((n, t, 2))
        unary[:, :, 1] = np.bincount(row, w[column], minlength=n * t).reshape(n, t)
        p, expected = expectations(unary, mask, a)
        error = np.where(mask, y - p, 0).ravel()
        grads = (np.bincount(column, error[row], minlength=len(w)) / n - PENALTY * w, (seen - expected) / n - PENALTY * a)
        for k, (value, g) in enumerate(zip((w, a), grads)):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            value += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(w[k]) for f, k in index.items()}, a)


def decode(model: Model, found: list[Block]) -> list[bool]:
    """The most likely labels of a page's blocks (Viterbi)."""
    if not found:
        return []
    weight = model.weights.get
    (a00, a01), (a10, a11) = model.transitions.tolist()
    s0 = s1 = 0.0
    back: list[tuple[bool, bool]] = []
    for k, (b, place) in enumerate(zip(found, inside(found))):
        u = sum(weight(f, 0.0) for f in features(b, k, place))
        if not k:
            s0, s1 = 0.0, u
            continue
        from0, from1 = (s0 + a00 < s1 + a10), (s0 + a01 < s1 + a11)
        s0, s1 = max(s0 + a00, s1 + a10), max(s0 + a01, s1 + a11) + u
        back.append((from0, from1))
    label = s1 > s0
    out = [label]
    for pointers in reversed(back):
        label = pointers[label]
        out.append(label)
    return out[::-1]


_MODEL: list[Model] = []


def model() -> Model:
    """The model of the built-in training pages, fitted once in a process."""
    if not _MODEL:
        _MODEL.append(train(htmlpages.pages(TRAINING_PAGES)))
    return _MODEL[0]


def main_text(page: str | None, m: Model) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, decode(m, found)) if y)


def extract(pages: DataFrame, m: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(m or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "html"):
                texts = [main_text(x, sent.value) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.text_column(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
