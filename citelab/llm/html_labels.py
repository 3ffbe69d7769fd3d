"""Labelled pages that the model of html_extract is fitted on, composed by rule from usual page parts.

Every block element carries data-y: 1 for the article's own blocks, 0 for everything else.
"""

from __future__ import annotations

import random

#: Names that authors give to parts of a page, by whether the part is the article.
ARTICLE = ["article", "content", "post", "entry", "story", "main", "body", "text", "post-body", "article-content", "entry-content", "story-body", "page-content", "prose", "markdown"]
#: Names that say nothing.
PLAIN = ["col-8", "col-md-9", "col-4", "row", "inner", "wrap", "box", "block", "left", "right", "panel", "module", "view", "region", "grid", "cell", "c1", "x2", "css-1a2b", "section", "item", "clearfix", "flex", "layout", "area"]
NOT = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "site-nav", "pagination", "tabs", "toc"],
    "header": ["header", "site-header", "masthead", "top", "page-header", "banner", "logo", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "rail", "popular", "trending", "more-stories", "tags", "author-bio"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "adslot"],
    "notice": ["notice", "cookie", "cookies", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "subscribe", "newsletter", "disclaimer", "warning"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form"],
    "comments": ["comments", "comment", "comment-list", "replies", "responses", "discussion", "disqus", "reader-comments", "feedback"],
    "share": ["share", "social", "sharing", "follow", "buttons", "toolbar", "meta", "byline"],
}


def _words(rng: random.Random, least: int, most: int) -> str:
    out = ["".join(rng.choice("aeioulnrstdmpk") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(least, most))]
    if rng.random() < 0.1:
        out.append("&amp;")
    return " ".join(out).capitalize() + rng.choice([".", ".", "", "!"])


def _attrs(rng: random.Random, names: list[str], y: int, always: bool = False) -> str:
    key = rng.choice(["class", "class", "id"])
    name = f' {key}="{rng.choice(names)}"' if always or rng.random() < 0.6 else ""
    if rng.random() < 0.1:
        name += f' data-k="{rng.choice(PLAIN)}"'
    return f'{name} data-y="{y}"'


def _article(rng: random.Random) -> str:
    y = ' data-y="1"'
    out = [f"<h1{y}>{_words(rng, 3, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 10)):
        what = rng.random()
        if what < 0.62:
            inner = _words(rng, 1, 4 if rng.random() < 0.4 else 90)
            if rng.random() < 0.3:
                inner += f" <a href='/x'>{_words(rng, 1, 4)}</a> {_words(rng, 2, 20)}"
            if rng.random() < 0.2:
                inner = f"<b>{inner}<br>"
            out.append(f"<p{y}>{inner}" + ("</p>" if rng.random() < 0.9 else ""))
        elif what < 0.7:
            out.append(f"<h{rng.randint(2, 4)}{y}>{_words(rng, 1, 7)}</h3>")
        elif what < 0.78:
            out.append(f"<ul{y}>" + "".join(f"<li{y}>{_words(rng, 1, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif what < 0.83:
            out.append(f"<blockquote{y}><p{y}>{_words(rng, 4, 40)}</p></blockquote>")
        elif what < 0.87:
            out.append(f"<pre{y}>{_words(rng, 4, 30)}</pre>")
        elif what < 0.91:
            out.append(f"<table{y}><tr{y}>" + "".join(f"<td{y}>{_words(rng, 1, 5)}</td>" for _ in range(3)) + "</tr></table>")
        elif what < 0.95:
            out.append(f"<figure{y}><img src='a.png'><figcaption{y}>{_words(rng, 2, 12)}</figcaption></figure>")
        elif what < 0.97:
            out.append(f"<div{y}>{_words(rng, 10, 60)}</div>")
        elif what < 0.985:
            out.append(_details(rng))
        else:
            out.append(f"<p{y}>{_words(rng, 1, 12)} <math><mi>x</mi><mo>=</mo><mn>{rng.randint(1, 99)}</mn></math> {_words(rng, 1, 12)}</p>")
    if rng.random() < 0.15:  # what it refers to
        out.append((f"<h2{y}>{_words(rng, 1, 3)}</h2>" if rng.random() < 0.6 else "") + f"<ul{y}>" + "".join(f'<li{y}><a href="/r/{i}">{_words(rng, 2, 12)}</a></li>' for i in range(rng.randint(1, 4))) + "</ul>")
    if rng.random() < 0.1:
        out.append(_details(rng))
    if rng.random() < 0.12 and out[0].startswith("<h1"):  # a header of its own
        out[0] = f"<header{y}>{out[0]}" + (f"<p{y}>{_words(rng, 3, 20)}</p>" if rng.random() < 0.4 else "") + "</header>"
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) if rng.random() < 0.6 else 0):  # parts that authors put inside
        out.insert(rng.randint(0, len(out)), _part(rng, rng.choice(["ad", "aside", "share", "notice", "form", "comments"])))
    return "".join(out)


def _details(rng: random.Random) -> str:
    y = ' data-y="1"'
    return f"<details{y}><summary{y}>{_words(rng, 1, 6)}</summary>{rng.choice([_words(rng, 5, 40), f'<p{y}>{_words(rng, 5, 40)}</p>'])}</details>"


def _links(rng: random.Random) -> str:
    return '<ul data-y="0">' + "".join(f'<li data-y="0"><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(rng.randint(2, 8))) + "</ul>"


def _part(rng: random.Random, kind: str) -> str:
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, rng.choice(["div", "div", "section", "aside"]))
    always = tag in ("div", "section")
    if kind != "form" and rng.random() < 0.3:
        tag, always = "div", True
    p = lambda a, b: f'<p data-y="0">{_words(rng, a, b)}</p>'
    body = {
        "nav": lambda: _links(rng),
        "header": lambda: (f'<div data-y="0"><a href="/">{_words(rng, 1, 3)}</a></div>' if rng.random() < 0.5 else f'<h1 data-y="0">{_words(rng, 1, 4)}</h1>') + (_part(rng, "nav") if rng.random() < 0.4 else ""),
        "footer": lambda: rng.choice([f"&copy; {_words(rng, 1, 20)}", p(2, 25), _links(rng) + p(2, 10)]),
        "aside": lambda: f'<h3 data-y="0">{_words(rng, 1, 4)}</h3>' + rng.choice([_links(rng), p(3, 30), p(3, 30) + _links(rng)]),
        "ad": lambda: rng.choice([_words(rng, 2, 30), p(2, 30), f'<a href="/buy">{_words(rng, 2, 12)}</a>']),
        "notice": lambda: rng.choice([_words(rng, 4, 40), p(4, 40), p(4, 30) + "<button>ok</button>"]),
        "form": lambda: f'<label>{_words(rng, 1, 4)}</label><input name="a"><button>{_words(rng, 1, 2)}</button>' + (p(2, 12) if rng.random() < 0.4 else ""),
        "comments": lambda: f'<h3 data-y="0">{_words(rng, 1, 3)}</h3>' + "".join(f"<{t} {_attrs(rng, NOT['comments'], 0).strip()}>{p(2, 60)}</{t}>" for t in [rng.choice(["div", "div", "div", "li", "li", "article"])] * rng.randint(1, 3)),
        "share": lambda: rng.choice([_links(rng), p(2, 8), _words(rng, 2, 6)]),
    }[kind]()
    # a list of links or a form shows what it is without a name
    names = PLAIN if kind in ("nav", "form") and rng.random() < 0.3 else NOT[kind]
    return f"<{tag}{_attrs(rng, names, 0, always and names is not PLAIN)}>{body}</{tag}>"


def _table(rng: random.Random) -> str:
    """A page laid out by a table: a bar, the menu beside the article, what is below."""
    td = lambda y, inner: f'<td data-y="{y}">{inner}</td>'
    menu = rng.choice([_links(rng), "<br>".join(f'<a href="/{i}">{_words(rng, 1, 3)}</a>' for i in range(rng.randint(2, 8)))])
    rows = [f'<tr data-y="0">{td(0, rng.choice([_words(rng, 1, 4), _links(rng)]))}</tr>'] * (rng.random() < 0.6)
    cells = [td(0, menu), td(1, _article(rng))]
    if rng.random() < 0.3:
        cells.reverse()
    rows.append(f'<tr data-y="0">{"".join(cells)}</tr>')
    rows += [f'<tr data-y="0">{td(0, "&copy; " + _words(rng, 1, 8))}</tr>'] * (rng.random() < 0.6)
    return f'<table data-y="0">{"".join(rows)}</table>'


def _blocks(rng: random.Random) -> str:
    """Divisions whose names say nothing: links, text broken by line ends or in paragraphs, a line below."""
    div = lambda y, inner: f'<div{rng.choice(["", "", f" id={rng.choice(PLAIN[-12:] + list("abcdefg"))}", f" class={rng.choice(PLAIN)}"])} data-y="{y}">{inner}</div>'
    link = lambda i: f'<a href="/{i}">{_words(rng, 1, 3)}</a>'
    line = lambda a, b: _words(rng, a, b).rstrip(".!") + "."
    bar = rng.choice([" ", "<br>", " | "]).join(link(i) for i in range(rng.randint(2, 8)))
    sentences = rng.choice(["<br>", " ", "<br><br>"]).join(line(4, 30) for _ in range(rng.randint(2, 12)))
    what = rng.random()
    body = sentences if what < 0.5 else "".join(f'<p data-y="1">{_words(rng, 4, 60)}</p>' for _ in range(rng.randint(1, 6))) if what < 0.8 else f'<h1 data-y="1">{_words(rng, 1, 9)}</h1>{sentences}'
    if rng.random() < 0.2:
        body = div(1, body)
    below = rng.choice(["Copyright ", "&copy; ", "All rights reserved ", ""]) + _words(rng, 0, 5)
    parts = [div(0, bar)] * (rng.random() < 0.8) + [div(1, body)] + [div(0, _words(rng, 1, 5))] * (rng.random() < 0.15) + [div(0, below)] * (rng.random() < 0.8)
    if rng.random() < 0.2:
        parts.insert(0, div(0, _words(rng, 1, 4)))
    return "".join(parts)


def page(seed: int) -> str:
    rng = random.Random(seed)
    kind = rng.random()
    if kind < 0.04:  # text only
        return _words(rng, 1, 80)
    parts = 0.45 if kind < 0.75 else 0.08  # some pages have hardly anything but the article
    before = [_part(rng, k) for k in ("notice", "header", "nav", "ad", "share", "form") if rng.random() < parts]
    after = [_part(rng, k) for k in ("comments", "aside", "ad", "share", "form", "notice") if rng.random() < parts * 0.8]
    after += [_part(rng, "footer")] if rng.random() < 2 * parts else []
    tag = rng.choice(["article", "article", "main", "div", "div", "div", "section"])
    names = PLAIN if rng.random() < 0.4 else ARTICLE
    inner = _article(rng) if kind < 0.75 or rng.random() < 0.4 else "".join(f'<p data-y="1">{_words(rng, 1, 40)}</p>' for _ in range(rng.randint(1, 3)))
    bare = kind > 0.95  # paragraphs right in the body
    main = inner if bare else f"<{tag}{_attrs(rng, names, 1, tag in ('div', 'section') and names is ARTICLE)}>{inner}</{tag}>"
    if rng.random() < 0.3 and not bare:
        main = f'<{rng.choice(["main", "div"])}{_attrs(rng, ["container", "wrapper", "page", "main", "layout", "row", "content", *PLAIN], 1)}>{main}' + "</main></div>"
    body = "".join([*before, main, *after])
    if 0.70 < kind < 0.75:
        body, bare = _table(rng), False
    if 0.60 < kind < 0.70:
        body, bare = _blocks(rng), False
    if rng.random() < 0.3 and not bare:
        body = f'<div class="{rng.choice(["container", "wrapper", "page", "site", *PLAIN])}" data-y="0">{body}</div>'
    top = f'<!DOCTYPE html><html data-y="0"><head><title>{_words(rng, 2, 6)}</title><style>p{{}}</style></head>' if rng.random() < 0.85 else ""
    return f'{top}<body data-y="{int(bare)}">{body}</body>' + "</html>" * bool(top)


def pages(n: int = 1500, seed: int = 11) -> list[str]:
    return [page(seed * 10_000 + i) for i in range(n)]
