"""Labelled web pages to train the block labeller on.

Pages are built by rule: an article of headings, paragraphs, lists, quotes and
tables, in one of several kinds of container, among menus, page headers, footers,
sidebars, notices, adverts, forms and reader comments, marked up with semantic
tags or by class names. Each text block carries its label: True in the article.
"""

from __future__ import annotations

import random

#: Class or id names by what they mark.
NAMES = {
    "menu": ("nav", "menu", "navbar", "main-menu", "site-nav", "breadcrumb", "breadcrumbs", "pagination", "tabs"),
    "header": ("header", "masthead", "top-bar", "site-header", "branding", "topbar"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "colophon", "legal"),
    "sidebar": ("sidebar", "aside", "widget", "rail", "related", "right-column", "related-posts", "recommended", "trending", "tags"),
    "notice": ("notice", "cookie-banner", "cookie-consent", "alert", "popup", "modal", "gdpr", "cookies", "disclaimer"),
    "advert": ("ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement", "sponsor", "ad-slot", "adsbox"),
    "form": ("form", "newsletter", "subscribe", "login", "search", "signup", "contact-form"),
    "comments": ("comments", "comment-list", "comment", "discussion", "replies", "disqus", "responses", "comment-body"),
    "share": ("share", "social", "sharing", "share-buttons"),
    "content": ("content", "post", "entry-content", "article-body", "main-content", "story", "post-body", "text", "article", "entry", "page-content"),
    "neutral": ("wrap", "container", "row", "inner", "box", "col", "block", "outer", "grid", "section"),
}

_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}
_SYLLABLES = "ba co di fu ge ha in ker lo mi no pra qua res ti un ver wo ex tion ing the an der les".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[bool] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice("....?!")

    def prose(self, low: int, high: int) -> str:
        r = self.r
        text = " ".join(self.sentence() for _ in range(r.randint(low, high)))
        if r.random() < 0.2:
            first, _, rest = text.partition(" ")
            text = f'{first} <a href="/x">{self.words(1, 3)}</a> {rest}'
        if r.random() < 0.15:
            text = f"<{(t := r.choice(('b', 'em', 'strong', 'span')))}>{self.words(1, 4)}</{t}> " + text
        return text

    def block(self, tag: str, text: str, label: bool) -> None:
        self.out.append(f"<{tag}>{text}</{tag}>")
        self.labels.append(label)

    def bare(self, text: str) -> None:
        """Text that stands in its container itself."""
        self.out.append(text)
        self.labels.append(False)

    def open(self, kind: str, semantic: bool) -> str:
        r = self.r
        tag = _TAGS.get(kind, "div") if semantic else r.choice(("div", "div", "section", "ul" if kind == "menu" else "div"))
        named = not semantic or r.random() < 0.4 or kind in ("advert", "notice", "comments", "share")
        mark = f' {r.choice(("class", "class", "id"))}="{r.choice(NAMES[kind])}"' if named else ""
        self.out.append(f"<{tag}{mark}>")
        return tag

    def around(self, kind: str, semantic: bool) -> None:
        r = self.r
        tag = self.open(kind, semantic)
        if kind not in ("menu", "share", "comments") and r.random() < 0.4:
            mark = "&copy; " if kind == "footer" and r.random() < 0.7 else ""
            self.bare(mark + (self.words(1, 5) + " &middot; " if r.random() < 0.3 else "") + self.prose(1, 2))
            self.out.append(f"</{tag}>")
            return
        if kind in ("menu", "share") or kind in ("sidebar", "footer") and r.random() < 0.5:
            listed = tag != "ul"
            if listed:
                self.out.append("<ul>")
            for _ in range(r.randint(3, 8)):
                self.block("li", f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>', False)
            if listed:
                self.out.append("</ul>")
        if kind == "header":
            self.block(r.choice(("div", "p", "h2")), self.words(1, 5).title(), False)
        if kind == "footer":
            self.block(r.choice(("p", "div")), f"&copy; {r.randint(1999, 2026)} {self.words(1, 4)} &middot; " + self.sentence(2, 8), False)
        if kind == "sidebar":
            self.block("h3", self.words(1, 3).title(), False)
            for _ in range(r.randint(0, 2)):
                self.block("p", self.prose(1, 2), False)
        if kind in ("notice", "advert"):
            for _ in range(r.randint(1, 2)):
                self.block(r.choice(("p", "div")), self.prose(1, 3), False)
        if kind == "form":
            self.block(r.choice(("label", "p")), self.words(1, 6).capitalize(), False)
            self.block("button", self.words(1, 2).capitalize(), False)
        if kind == "comments":
            self.block("h3", f"{r.randint(2, 90)} {self.words(1, 2)}", False)
            for _ in range(r.randint(1, 5)):
                self.out.append(f'<div class="{r.choice(NAMES["comments"])}">')
                self.block(r.choice(("div", "p")), self.words(1, 2), False)
                self.block("p", self.prose(1, 3), False)
                self.out.append("</div>")
        self.out.append(f"</{tag}>")

    def article(self, semantic: bool, inner: list[str]) -> None:
        r = self.r
        shell = r.random() < 0.5
        if shell:
            self.out.append(f'<{r.choice(("main", "div"))} class="{r.choice(NAMES["neutral"])}">')
        tag = r.choice(("article", "article", "main")) if semantic else "div"
        mark = "" if semantic and r.random() < 0.7 else f' {r.choice(("class", "id"))}="{r.choice(NAMES["content"])}"'
        self.out.append(f"<{tag}{mark}>")
        if r.random() < 0.9:
            wrapped = r.random() < 0.15
            self.out.append("<header>" if wrapped else "")
            self.block("h1", self.words(2, 12).capitalize(), True)
            self.out.append("</header>" if wrapped else "")
        cut = r.random() < 0.3
        self.out.append("<section>" if cut else "")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if cut and r.random() < 0.2:
                self.out.append("</section><section>")
            if kind < 0.68:
                self.block("p", self.prose(1, 7), True)
            elif kind < 0.76:
                self.block(r.choice(("h2", "h3")), self.words(1, 7).capitalize(), True)
            elif kind < 0.84:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.block("li", self.prose(1, 2) if r.random() < 0.6 else self.words(1, 6), True)
                self.out.append("</ul>")
            elif kind < 0.88:
                self.block("blockquote", self.prose(1, 3), True)
            elif kind < 0.92:
                self.out.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.block("td", self.words(1, 4), True)
                self.out.append("</tr></table>")
            elif kind < 0.95:
                self.block("pre", self.words(3, 20), True)
            else:
                self.out.append("<figure>")
                self.block("figcaption", self.sentence(3, 10), True)
                self.out.append("</figure>")
            if inner and r.random() < 0.25:
                self.around(inner.pop(), semantic)
        if r.random() < 0.25:
            self.block(r.choice(("p", "p", "div", "h3")), r.choice((self.words(1, 4).capitalize() + ".", "All rights reserved.", " | ".join(self.words(1, 1) for _ in range(5)))), True)
        self.out.append("</section>" if cut else "")
        for kind in inner:
            self.around(kind, semantic)
        self.out.append(f"</{tag}>")
        if shell:
            self.out.append("</div>")


def page(seed: int) -> tuple[str, list[bool]]:
    """One page and the labels of its text blocks in order."""
    w = _Writer(seed)
    r = w.r
    semantic = r.random() < 0.55
    w.out.append(f'<!DOCTYPE html><html><head><title>{w.words(2, 8)}</title><style>p{{margin:0}}</style><script>var a="<p>x</p>";</script></head><body>')
    if not semantic and r.random() < 0.5:
        w.out.append(f'<div class="{r.choice(NAMES["neutral"])}">')
    before = [k for k in ("header", "menu", "notice", "advert", "sidebar") if r.random() < 0.5]
    after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if r.random() < 0.45]
    inside = [k for k in ("advert", "share", "comments", "form") if r.random() < 0.2]
    for k in before:
        w.around(k, semantic)
    w.article(semantic, inside)
    for k in after:
        w.around(k, semantic)
    w.out.append("</body></html>")
    return "".join(w.out), w.labels


def pages(count: int, seed: int = 1) -> list[tuple[str, list[bool]]]:
    return [page(seed * 100_003 + k) for k in range(count)]
