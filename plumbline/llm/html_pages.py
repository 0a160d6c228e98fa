"""Labelled pages to train the extraction model on: layouts put together from parts whose label is known.

What belongs to the article carries the attribute data-content="1" on its outermost element, and what
does not, though it stands inside such an element, data-content="0".
"""

from __future__ import annotations

import random

#: Names that sites give to the parts of a page.
NAMES = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "toc"],
    "header": ["header", "masthead", "site-header", "topbar", "banner"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "legal"],
    "side": ["sidebar", "widget", "related", "share", "social", "tags", "recommended", "popular", "author-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"],
    "notice": ["cookie", "notice", "consent", "popup", "modal", "newsletter", "subscribe", "alert"],
    "comment": ["comments", "comment", "comment-list", "reply", "discussion", "disqus", "respond"],
    "form": ["search", "login", "contact-form", "signup"],
    "content": ["content", "article", "post", "entry", "story", "main-content", "article-body", "post-body", "entry-content", "text"],
}
SYLLABLES = "ba ce di fo gu la me ni ro su ta ve wi xo zu an er in or st".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, a: int, b: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(a, b)))


def _prose(r: random.Random, least: int = 3) -> str:
    return " ".join(_words(r, least, 24).capitalize() + r.choice(".....!?") for _ in range(r.choice([1, 1, 2, 3, 5])))


def _named(r: random.Random, kind: str, tags: list[str], inner: str, mark: str = "") -> str:
    tag = r.choice(tags)
    plain = tag in ("nav", "header", "footer", "aside", "article", "main", "form")
    name = "" if plain and r.random() < 0.6 else f' {r.choice(["class", "class", "id"])}="{r.choice(NAMES[kind])}"'
    return f"<{tag}{name}{mark}>{inner}</{tag}>"


def _links(r: random.Random) -> str:
    items = [f'<a href="/{_word(r)}">{_words(r, 1, 4)}</a>' for _ in range(r.randint(2, 8))]
    return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])


def _aside(r: random.Random, kind: str, mark: str = "") -> str:
    inner = {
        "nav": lambda: _links(r),
        "header": lambda: r.choice([f"<h1>{_words(r, 1, 4)}</h1>", f'<a href="/">{_words(r, 1, 3)}</a>']) + r.choice(["", f"<p>{_words(r, 2, 8)}</p>", _links(r)]),
        "footer": lambda: r.choice(["&copy; ", "Copyright ", ""]) + f"{_words(r, 1, 4)} &middot; {_prose(r)}" + r.choice(["", _links(r)]),
        "side": lambda: f"<h3>{_words(r, 1, 3)}</h3>" + r.choice([_links(r), f"<p>{_prose(r)}</p>"]),
        "ad": lambda: r.choice([_prose(r), f"<p>{_prose(r)}</p>", f'<a href="/x">{_words(r, 3, 10)}</a>']),
        "notice": lambda: r.choice(["", "<p>"]) + _prose(r) + f"<button>{_words(r, 1, 2)}</button>",
        "comment": lambda: f"<h3>{_words(r, 1, 2)}</h3>" + "".join(f'<div class="comment"><b>{_word(r)}</b><p>{_prose(r)}</p></div>' if r.random() < 0.5 else f"<li><p>{_prose(r)}</p></li>" for _ in range(r.randint(1, 5))),
        "form": lambda: f"<label>{_words(r, 1, 3)}</label><input name=q>{r.choice(['', f'<p>{_words(r, 4, 12)}.</p>'])}<button>{_word(r)}</button>",
    }[kind]()
    tags = {"nav": ["nav", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside"],
            "notice": ["div", "section"], "comment": ["section", "div"], "form": ["form"]}[kind]
    return _named(r, kind, tags, inner, mark)


def _article(r: random.Random) -> str:
    parts = [r.choice([f"<h1>{_words(r, 1, 12).capitalize()}{r.choice(['', '', '.', '?'])}</h1>", ""])]
    for _ in range(r.randint(1, 12)):
        parts.append(r.choice([
            f"<p>{_prose(r)}</p>", f"<p>{_prose(r)}</p>", f"<p>{_prose(r)}", f"<p>{_prose(r, 1)}</p>", f"<p>{_words(r, 1, 3).capitalize()}.</p>",
            f"<p><b>{_prose(r)}<br>", f"<p>{_words(r, 1, 6)}</p>", f"<h2>{_words(r, 1, 8)}</h2>", f"<h3>{_words(r, 1, 6)}</h3>", f'<p>{_prose(r)} <a href="/y">{_words(r, 1, 4)}</a> {_prose(r)}</p>',
            "<ul>" + "".join(f"<li>{_prose(r)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", f"<blockquote>{_prose(r)}</blockquote>",
            f"<pre>{_words(r, 3, 20)}</pre>", "<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 6)}</td></tr>" for _ in range(3)) + "</table>",
            f"<figure><img src=x><figcaption>{_words(r, 3, 12)}.</figcaption></figure>"]))
    if r.random() < 0.25:
        parts.insert(r.randint(1, len(parts)), _aside(r, r.choice(["ad", "side", "notice", "comment", "form"]), ' data-content="0"'))
    return _named(r, "content", ["article", "article", "main", "div", "div", "section"], "".join(parts), ' data-content="1"')


def page(seed: int) -> str:
    r = random.Random(seed)
    before = [_aside(r, k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.5]
    after = [_aside(r, k) for k in ("side", "ad", "comment", "form", "nav", "footer") if r.random() < 0.5]
    body = "".join(before) + _article(r) + "".join(after)
    if r.random() < 0.4:
        body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
