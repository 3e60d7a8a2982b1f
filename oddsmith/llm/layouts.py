"""Labelled pages to learn from: pieces of real text in random layouts.

A layout puts a main text between the menus, headers, sidebars, notices, adverts, forms, reader
comments and footers that surround one, in the elements and with the class words that pages use,
or without either.  The main text's runs begin with ``MARK``, which tells the label after parsing.
"""

from __future__ import annotations

import random
from html import escape

import numpy as np

from oddsmith.llm.dom import FAMILIES, Tree

#: a private-use character, taken out of pieces
MARK = "\ue000"
#: used where the sampled pages hold no text
STOCK = ["Home", "Read on", "A short line of text.", "The first sentence stands here, and a second one follows it. Then there is a third.", "Words without an end"]


class Layout:
    """Writes one random page."""

    def __init__(self, seed: int, pieces: list[str]):
        self.rng, self.pieces = random.Random(seed), [p.split() for p in pieces]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *options):
        return self.rng.choice(options)

    def number(self, low: int, high: int) -> int:
        """At least ``low`` and at most ``high``."""
        return self.rng.randint(low, high)

    def words(self, low: int, high: int) -> str:
        """Between ``low`` and ``high`` words of the sampled text."""
        want, found = self.number(low, high), []
        while len(found) < want:
            found += self.rng.choice(self.pieces)
        at = self.number(0, len(found) - want)
        return escape(" ".join(found[at : at + want]), quote=False)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 22).rstrip(",") + self.pick(".", ".", ".", "!", "?") for _ in range(self.number(low, high)))

    def name(self, *families: str, bare: float = 0.3) -> str:
        """A class or id of one of the families, of a meaningless word, or none."""
        if self.chance(bare):
            return "" if self.chance(0.6) else f' class="{self.pick("x", "c", "b")}{self.rng.randrange(100)}"'
        word = self.pick(*FAMILIES[self.pick(*families)].split())
        if self.chance(0.3):
            word = self.pick(f"{word}-{self.pick('box', 'area', 'list', 'block', '1')}", f"site-{word}", f"{word}_{self.rng.randrange(9)}")
        return f' {self.pick("class", "class", "id", "role" if word.isalpha() else "class")}="{word}"'

    def element(self, tag: str, inside: str, attributes: str = "") -> str:
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(1000)}">{text}</a>'

    def links(self, low: int, high: int) -> str:
        """A list of links."""
        items = [self.link(self.words(1, 6 if self.chance(0.3) else 2)) for _ in range(self.number(low, high))]
        style = self.pick("ul", "ul", "ol", "div", "line", "p")
        if style in ("ul", "ol"):
            return self.element(style, "".join(f"<li>{x}" + ("</li>" if self.chance(0.8) else "") for x in items))
        if style == "line":
            return self.pick(" | ", " ", " · ").join(items)
        return "".join(self.element(style, x) for x in items)

    # what is not main text

    def menu(self) -> str:
        tag = self.pick("nav", "nav", "div", "ul", "td")
        inside = self.links(2, 12)
        return self.element("nav" if tag == "nav" else "div", inside, "" if tag == "nav" and self.chance(0.7) else self.name("nav", bare=0.15))

    def head(self) -> str:
        inside = self.pick(self.element("h1", self.words(1, 4)), self.element("div", self.words(1, 4), self.name("header")), self.link(self.words(1, 3)), self.element("p", self.words(2, 10)))
        if self.chance(0.4):
            inside += self.menu()
        if self.chance(0.3):
            inside += self.form()
        return self.element("header", inside) if self.chance(0.6) else self.element("div", inside, self.name("header", bare=0.1))

    def foot(self) -> str:
        text = self.pick(f"&copy; {self.number(1998, 2025)} {self.words(1, 4)}", f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.sentences(1, 2), f"{self.words(2, 5)}. All rights reserved.")
        inside = self.pick(text, self.element("p", text), self.links(2, 6) + self.element("p", text), self.element("div", text) + self.links(2, 8))
        return self.element("footer", inside) if self.chance(0.7) else self.element("div", inside, self.name("footer", bare=0.05))

    def notice(self) -> str:
        inside = self.pick(self.sentences(1, 3), self.element("p", self.sentences(1, 3)))
        if self.chance(0.6):
            inside += self.pick(self.link(self.words(1, 2)), self.element("button", self.words(1, 2)))
        return self.element(self.pick("div", "div", "section", "aside"), inside, self.name("notice", bare=0))

    def advert(self) -> str:
        inside = self.pick(self.sentences(1, 3), self.element("p", self.sentences(1, 2)), self.link(self.words(2, 12)), self.element("h3", self.words(1, 5)) + self.element("p", self.sentences(1, 2)))
        return self.element(self.pick("div", "div", "section", "aside", "p"), inside, self.name("advert", bare=0))

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=q>" for _ in range(self.number(1, 3)))
        lead = self.pick("", self.element("p", self.sentences(1, 2)), self.element("h3", self.words(1, 4)))
        return self.element("form", lead + fields + self.element("button", self.words(1, 2)), self.name("form", bare=0.5))

    def side(self) -> str:
        parts = [self.element(self.pick("h2", "h3", "h4"), self.words(1, 4)) + self.pick(self.links(2, 10), self.element("p", self.sentences(1, 3)), self.links(2, 5)) for _ in range(self.number(1, 3))]
        inside = "".join(self.element("div", p, self.name("side", "related")) if self.chance(0.5) else p for p in parts)
        return self.element("aside", inside, self.name("side", bare=0.6)) if self.chance(0.5) else self.element("div", inside, self.name("side", bare=0.05))

    def comments(self) -> str:
        tag = self.pick("li", "div", "div", "article", "p")
        each = []
        for _ in range(self.number(1, 7)):
            who = self.pick(self.link(self.words(1, 2)), self.element("b", self.words(1, 2)), self.element("h4", self.words(1, 2)), "")
            body = self.pick(self.sentences(1, 5), self.sentences(1, 5) if tag == "p" else self.element("p", self.sentences(1, 6)))
            each.append(self.element(tag, who + " " + body, self.name("comment", bare=0.4)))
        lead = self.element(self.pick("h2", "h3"), self.words(1, 3)) if self.chance(0.7) else ""
        inside = lead + (self.element("ul", "".join(each)) if tag == "li" else "".join(each)) + (self.form() if self.chance(0.4) else "")
        return self.element(self.pick("div", "section", "section"), inside, self.name("comment", bare=0))

    def aside_part(self) -> str:
        """Something of no interest inside the main text's element."""
        kind = self.pick("share", "related", "meta", "advert", "form")
        if kind == "advert":
            return self.advert()
        if kind == "form":
            return self.form()
        inside = self.links(2, 6) if kind != "meta" else self.pick(self.words(1, 6), self.link(self.words(1, 3)))
        lead = self.element("h4", self.words(1, 4)) if kind == "related" else ""
        return self.element(self.pick("div", "div", "aside", "section"), lead + inside, self.name(kind, bare=0))

    # main text

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.number(0, 2)):
            k = self.rng.randrange(len(words))
            words[k] = self.pick(self.link(words[k]), f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", f"<span>{words[k]}</span>")
        return MARK + " ".join(words)

    def paragraph(self) -> str:
        text = self.inline(self.pick(self.sentences(1, 8), self.sentences(1, 8), self.sentences(1, 2), self.words(1, 6), self.words(1, 1) + "."))
        return self.pick(self.element("p", text), self.element("p", text), self.element("p", text), f"<p>{text}", f"<p><b>{text}<br>", self.element("div", text), f"{text}<br><br>", self.element("section", self.element("p", text)))

    def special(self) -> str:
        item = lambda tag: self.element(tag, self.inline(self.pick(self.sentences(1, 2), self.words(1, 8))))
        many = lambda tag: "".join(item(tag) for _ in range(self.number(1, 7)))
        return self.pick(
            lambda: self.element(self.pick("ul", "ol"), many("li")), lambda: self.element("blockquote", self.paragraph()), lambda: self.element("pre", self.inline(self.words(3, 30))),
            lambda: self.element("table", "".join(self.element("tr", many("td")) for _ in range(self.number(1, 4)))), lambda: self.element("figure", "<img src=x>" + item("figcaption")),
            lambda: self.element("dl", "".join(item("dt") + item("dd") for _ in range(self.number(1, 3)))),
        )()

    def main(self) -> str:
        parts = []
        if self.chance(0.85):
            title = self.element(self.pick("h1", "h1", "h1", "h2"), self.inline(self.words(1, 14)))
            parts.append(self.pick(title, title, title, self.element("header", title), self.element("div", title, self.name("header", "main", bare=0.6))))
        for _ in range(1 + int(self.rng.expovariate(0.13)) if self.chance(0.85) else 1):
            if self.chance(0.12):
                parts.append(self.element(self.pick("h2", "h3", "h4"), self.inline(self.words(1, 8))))
            parts.append(self.special() if self.chance(0.12) else self.paragraph())
        for _ in range(self.number(0, 2) if self.chance(0.4) else 0):
            parts.insert(self.number(0, len(parts)), self.aside_part())
        inside = "".join(parts)
        for _ in range(self.number(0, 2)):
            inside = self.element("div", inside, self.name("main", "wrap", bare=0.5))
        tag = self.pick("article", "article", "article", "main", "main", "div", "div", "section", "td")
        attributes = self.name("main", bare=0.7 if tag in ("article", "main") else 0.15)
        if tag == "td":
            return self.element("table", self.element("tr", self.element("td", inside, attributes)))
        return self.element(tag, inside, attributes)

    def page(self) -> str:
        before = [f() for f, p in ((self.notice, 0.25), (self.head, 0.5), (self.menu, 0.7), (self.form, 0.15), (self.advert, 0.4)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(before)
        # some pages hold no main text at all
        middle = [self.main()] if self.chance(0.93) else []
        if self.chance(0.35):
            middle.insert(self.number(0, len(middle)), self.side())
        after = [f() for f, p in ((self.comments, 0.35), (self.advert, 0.15), (self.aside_part, 0.2), (self.foot, 0.8), (self.notice, 0.1)) if self.chance(p)]
        if self.chance(0.25):
            # comments inside the element that holds the main text, after it
            middle = [self.element("div", "".join(middle) + (self.comments() if self.chance(0.5) else self.aside_part()), self.name("main", "wrap", bare=0.4))]
        body = "".join((*before, *middle, *after))
        for _ in range(self.number(0, 2)):
            body = self.element("div", body, self.name("wrap", bare=0.4))
        if self.chance(0.05):
            body = self.element("form", body)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><script>var a = 1;</script></head><body>{body}</body></html>"


def labels(tree: Tree) -> np.ndarray:
    """1 for each node that holds main text; takes the marks out of the tree."""
    marked = np.array([v is not None and MARK in v for v in tree.text])
    for i in np.flatnonzero(marked):
        text = tree.text[i].replace(MARK, "").strip()
        tree.text[i], tree.linked[i] = text or None, min(tree.linked[i], len(text))
    total = np.concatenate([[0], np.cumsum(marked)])
    return (total[np.array(tree.end)] > total[:-1]).astype(float)
