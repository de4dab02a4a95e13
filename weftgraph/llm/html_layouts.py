"""Labelled page layouts: what the weights of the main-text classifier are fitted to.

Pages are made from a seed: an article in one of several kinds of container, with or
without the elements and class names that would give it away, among the usual boilerplate.
Every text block is made of words of its own, so that its label can be looked up.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

#: Pages that the weights are fitted to, and their seed.
PAGES, SEED = 1200, 11


@dataclass
class Page:
    html: str = ""
    content: list[str] = field(default_factory=list)


class _Maker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.number = 0

    def words(self, low: int, high: int, stop: str = "") -> str:
        """Text of some words; the first one occurs nowhere else."""
        self.number += 1
        n = self.random.randint(low, high)
        parts = ["".join(self.random.choice("abcdefghinorstu") for _ in range(self.random.randint(2, 9))) for _ in range(n - 1)]
        for i in range(7, n - 1, 9):
            parts[i] += ","
        return " ".join([f"w{self.number}", *parts]) + stop

    def some(self, share: float) -> bool:
        return self.random.random() < share

    def article(self, page: Page) -> str:
        """Blocks of an article, all of them content."""
        out = []

        def add(shape: str, text: str) -> None:
            page.content.append(text)
            out.append(shape.format(text))

        if self.some(0.8):
            add("<h1>{}</h1>" if self.some(0.8) else "<h2>{}</h2>", self.words(1, 9))
        if self.some(0.25):
            add(self.random.choice(["<div>{}</div>", "<p>{}</p>", "<span>{}</span>"]), self.words(2, 4))
        plain = self.random.choice(["<p>{}</p>"] * 6 + ["<div>{}</div>", "<td>{}</td>", "<p>{}"])
        for _ in range(self.random.choice([1, 1, 2, 4, 8])):
            kind = self.random.random()
            if kind < 0.72:
                add(plain, self.words(12, 60, "."))
            elif kind < 0.84:
                add(plain, self.words(1, 5, "."))
            elif kind < 0.9:
                add("<h3>{}</h3>", self.words(2, 5))
            elif kind < 0.95:
                out.append("<ul>")
                for _ in range(self.random.randint(2, 4)):
                    add("<li>{}</li>" if self.some(0.8) else "<li><a href=x>{}</a></li>", self.words(2, 10))
                out.append("</ul>")
            else:
                add("<blockquote>{}</blockquote>", self.words(8, 25, "."))
        body = "".join(out)
        return f"<table><tr>{body}</tr></table>" if "<td>" in plain else body

    def boilerplate(self) -> str:
        """A piece of a page that isn't content, in one of its usual forms."""
        link = lambda low, high: f"<a href=x>{self.words(low, high)}</a>"
        links = lambda: "".join(f"<li>{link(1, 3)}</li>" for _ in range(self.random.randint(2, 7)))
        prose = lambda: f"<p>{self.words(10, 40, '.')}</p>"
        return self.random.choice(
            [
                lambda: f"<nav><ul>{links()}</ul></nav>",
                lambda: f"<ul>{links()}</ul>",
                lambda: f"<div class=menu>{link(1, 2)} {link(1, 2)} {link(1, 2)}</div>",
                lambda: f"<header><h1>{self.words(1, 4)}</h1><p>{self.words(4, 12, '.')}</p></header>",
                lambda: f"<aside>{prose()}</aside>",
                lambda: f"<div class=sidebar><h3>{self.words(1, 3)}</h3>{prose()}</div>",
                lambda: f"<div id=cookie-notice>{self.words(8, 30, '.')}</div>",
                lambda: f"<div class=ad>{self.words(4, 30, '.')}</div>",
                lambda: f"<form><label>{self.words(1, 3)}</label><input><p>{self.words(5, 20, '.')}</p><button>{self.words(1, 2)}</button></form>",
                lambda: f"<section class=comments><h3>{self.words(1, 2)}</h3>{prose()}{prose()}</section>",
                lambda: f"<footer>{self.words(3, 12)} {link(1, 2)}</footer>",
                lambda: f"<div>{link(1, 3)} | {link(1, 3)}</div>",
                lambda: f"<div>{self.words(1, 3)}</div>",
            ]
        )()

    def page(self) -> Page:
        page = Page()
        body = self.article(page)
        wrap = self.random.choice(
            ["<article>{}</article>"] * 3 + ["<main>{}</main>"] * 2 + ["<div class=content>{}</div>", "<div id=post-body>{}</div>"] + ["<div>{}</div>"] * 3 + ["{}"] * 2
        )
        body = wrap.format(body)
        if self.some(0.1):
            body = f"<form>{body}</form>"
        before = "".join(self.boilerplate() for _ in range(self.random.randint(0, 3)))
        after = "".join(self.boilerplate() for _ in range(self.random.randint(0, 3)))
        if self.some(0.06):
            before += f"<nav><a href=x>{self.words(1, 3)}</a>"  # never closed
        page.html = f"<html><body>{before}{body}{after}</body></html>"
        return page


def pages(n: int = PAGES, seed: int = SEED) -> list[Page]:
    """n labelled pages; the same for the same seed."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
