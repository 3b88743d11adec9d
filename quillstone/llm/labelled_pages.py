"""Pages whose blocks are labelled: what html_main learns its classifier from.

They are made from layouts that are common on the web, with random words, and know which of their
blocks are content. A bounded sample: PAGES pages, the same ones each time.
"""

from __future__ import annotations

import random

PAGES, SEED = 420, 5
#: How sentences end; one in five has no mark.
ENDS = (".", ".", ".", "?", "")
_LETTERS = "etaoinshrdlucmfwypvbgk"
#: Words of names of boilerplate, some of those that html_main knows.
BOILERPLATE = "sidebar ad ads banner nav navigation menu footer comment comments cookie notice popup newsletter share social related search legal widget promo form skip breadcrumbs masthead subscribe".split()


class _Maker:
    """Writes one page and remembers its content."""

    def __init__(self, rng: random.Random):
        self.rng, self.content = rng, set()

    def words(self, least: int, most: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_LETTERS) for _ in range(r.randint(2, 9))) for _ in range(r.randint(least, most)))

    def sentence(self, least: int, most: int) -> str:
        return self.words(least, most).capitalize() + self.rng.choice(ENDS)

    def good(self, text: str) -> str:
        self.content.add(text)
        return text

    def article(self, tag: str = "p") -> str:
        """Title, paragraphs short and long, a list, a subheading."""
        r = self.rng
        out = [f"<h1>{self.good(self.words(2, 10).capitalize())}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 9) if r.random() < 0.75 else r.randint(0, 1)):
            kind = r.random()
            if kind < 0.12:
                out.append(f"<h2>{self.good(self.words(1, 6).capitalize())}</h2>")
            elif kind < 0.22:
                out.append("<ul>" + "".join(f"<li>{self.good(self.sentence(2, 15))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.4:
                out.append(f"<{tag}>{self.good(self.sentence(1, 4))}</{tag}>")
            elif kind < 0.5:
                a, b, c = self.sentence(4, 20), self.words(1, 4), self.sentence(4, 20)
                self.good(f"{a} {b} {c}")
                out.append(f'<{tag}>{a} <a href="/x">{b}</a> {c}</{tag}>')
            else:
                out.append(f"<{tag}>{self.good(' '.join(self.sentence(4, 20) for _ in range(r.randint(1, 7))))}</{tag}>")
        return "".join(out)

    def links(self, item: str = "li", least: int = 3, most: int = 9) -> str:
        return "".join(f'<{item}><a href="/{k}">{self.words(1, 3)}</a></{item}>' for k in range(self.rng.randint(least, most)))

    def lines(self, tag: str = "p", least: int = 1, most: int = 4) -> str:
        """Sentences that aren't content."""
        return "".join(f"<{tag}>{self.sentence(2, 18)}</{tag}>" for _ in range(self.rng.randint(least, most)))

    def content_name(self) -> str:
        """Classes of a content container, among them names that state a layout or only begin with a word for boilerplate."""
        r = self.rng
        names = [r.choice(("content", "post", "entry-content", "article-body", "main-text", "site-main", "hentry", "story", "page-content"))]
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            word = r.choice(BOILERPLATE)
            names.append(r.choice((f"has-{word}", f"with-{word}", f"no-{word}", f"{word}-open", f"{word}-enabled", f"tag-{word}", f"category-{word}", f"page-with-{word}", f"{word}-target", self.words(1, 1))))
        if r.random() < 0.25:
            names[0] = f"{r.choice(BOILERPLATE)}-{self.words(1, 1)}"  # legal-news
        if r.random() < 0.06:
            names.append(r.choice(BOILERPLATE))
        r.shuffle(names)
        return " ".join(names)

    def boiler_name(self, word: str | None = None) -> str:
        r = self.rng
        word = word or r.choice(BOILERPLATE)
        own = r.choice((word, word, f"{r.choice(('site', 'main', 'post', 'entry', 'page'))}-{word}", f"{word}-{r.choice(('wrapper', 'area', 'inner', 'list', 'box'))}", f"{word}{r.choice(('list', 'links', 'box', 'area'))}", f"{word}-{r.choice(('content', 'body', 'text'))}", f"{word}-{self.words(1, 1)}"))
        return own if r.random() < 0.7 else f"{own} {self.words(1, 1)}"

    def comments(self) -> str:
        """What readers say, sometimes more than the article."""
        r = self.rng
        tag, item, body = r.choice((("ol", "li", "div"), ("div", "div", "div"), ("section", "article", "div"), ("ul", "li", "p")))
        said = "".join(f'<{item} class="{self.boiler_name("comment")}"><{body}>{" ".join(self.sentence(3, 18) for _ in range(r.randint(1, 5)))}</{body}></{item}>' for _ in range(r.randint(1, 7)))
        return f'<{tag} class="{self.boiler_name(r.choice(("comment", "comments", "respond", "replies")))}">{said}</{tag}>'

    def extras(self, named: bool) -> str:
        """What may stand in or beside an article."""
        r = self.rng
        names = ("ad", "sidebar", "comments", "notice", "share-links", "related", "newsletter", "cookie-banner")
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(("aside", "form", "menu", "dialog", "fieldset", "button", "hidden", *names)) if not named else r.choice(names)
            if kind == "comments":
                out.append(self.comments())
            elif kind in names and r.random() < 0.5:
                out.append(f'<div class="{self.boiler_name()}">{self.lines(r.choice(("p", "div")))}</div>')
            elif kind == "hidden":
                out.append(f"<div hidden>{self.lines()}</div>")
            elif kind == "button":
                out.append(f"<button>{self.words(1, 3)}</button>")
            elif kind in names:
                out.append(f'<div class="{kind}">{self.lines(r.choice(("p", "div")))}</div>')
            else:
                out.append(f"<{kind}>{self.links() if kind == 'menu' else self.lines()}</{kind}>")
        return "".join(out)


def _semantic(m: _Maker) -> str:
    body = f"<header><p>{m.words(1, 4)}</p>{m.links('div', 1, 4)}</header><nav><ul>{m.links()}</ul></nav>"
    main = m.rng.choice(("article", "main"))
    name = f' class="{m.content_name()}"' if m.rng.random() < 0.5 else ""
    return f"{body}{m.extras(False)}<{main}{name}>{m.article()}{m.extras(False)}</{main}><aside>{m.lines()}</aside><footer>{m.lines('p', 1, 6)}{m.links('div', 0, 5)}</footer>"


def _named(m: _Maker) -> str:
    what = m.rng.choice(("class", "class", "id"))
    return f'<div id="nav">{m.links()}</div><div {what}="{m.content_name()}">{m.article()}{m.extras(True)}</div>{m.extras(True)}<div id="footer">{m.lines("div", 1, 5)}</div>'


def _table(m: _Maker) -> str:
    return f"<table><tr><td>{m.links('div')}</td><td>{m.article()}</td></tr></table><p>{m.words(2, 6)}</p>"


def _bare(m: _Maker) -> str:
    return f"<ul>{m.links()}</ul><div>{m.article(m.rng.choice(('p', 'div')))}</div><div>{m.links('span', 2, 5)}</div><div>{m.words(2, 5)}</div>"


LAYOUTS = (_semantic, _semantic, _named, _named, _table, _bare)


def pages() -> list[tuple[str, frozenset]]:
    """(HTML, texts of its content blocks) of every page."""
    out = []
    for k in range(PAGES):
        m = _Maker(random.Random(SEED * 100_000 + k))
        body = LAYOUTS[k % len(LAYOUTS)](m)
        out.append((f"<!DOCTYPE html><html><head><title>{m.words(1, 5)}</title></head><body>{body}</body></html>", frozenset(m.content)))
    return out
