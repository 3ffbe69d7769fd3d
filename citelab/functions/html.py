"""Plain text and titles of web pages as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape as unescape_text
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.functions.text import collapse

#: Elements whose content isn't text of the page, and character references with a name.
DROPPED = ("script", "style", "nav", "header", "footer")
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "deg": "°", "times": "×", "trade": "™"}


def unescape(c) -> Column:
    """Character references by name (the common ones) and number; &amp; last, so nothing is decoded twice."""
    out = c
    for name, char in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    refs = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def char(ref: Column) -> Column:
        body = F.regexp_extract(ref, r"&#([^;]*);", 1)
        number = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 6), 16, 10)).otherwise(body).cast("long")
        ok = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")

    out = F.when(F.size(refs) == 0, out).otherwise(F.aggregate(refs, out, lambda t, r: F.replace(t, r, char(r))))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


#: Elements that never have content, and those whose content is raw.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
RAW = frozenset(("script", "style"))
#: What stands at a `<`: a comment, raw character data, a declaration or what is read as one, or a tag with its attributes. Each
#: runs to the end of the page if it isn't closed, and nothing is read twice.
MARKUP = re.compile(
    r"""<(?:
      !--(?:-?>|(?s:.*?)(?:--!?>|\Z))
    | !\[CDATA\[(?P<data>(?s:.*?))(?:\]\]>|\Z)
    | [!?][^>]*+(?:>|\Z)
    | /(?![a-zA-Z])[^>]*+(?:>|\Z)
    | (?P<end>/?)(?P<name>[a-zA-Z][^\t\n\r\f\ />]*+)
      (?:[\t\n\r\f\ ]++ | /(?!>) | [^\t\n\r\f\ />][^\t\n\r\f\ />=]*+
         (?:[\t\n\r\f\ ]*+=[\t\n\r\f\ ]*+(?:"[^"]*+(?:"|\Z) | '[^']*+(?:'|\Z) | [^\t\n\r\f\ >"'][^\t\n\r\f\ >]*+)?+)?+)*+
      (?:(?P<empty>/?)>|\Z)
    )""",
    re.VERBOSE,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\t\n\r\f />])", re.IGNORECASE) for name in RAW}


#: A reference that its semicolon ends.
CLOSED = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


def closed_references(text: str) -> str:
    """Only references that a semicolon ends; a name that isn't known stays, and so does what lacks its semicolon (`&amp` at a cut)."""
    return CLOSED.sub(lambda m: unescape_text(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def page_text(page: str, dropped: frozenset[str] = frozenset((*DROPPED, "template")), decode: Callable[[str], str] = unescape_text) -> str:
    """All text of a page but that of dropped elements; tags and comments part words, white space is one space. `decode` reads references.

    Elements are closed by their end tag, with all that is open within them; an end tag without its element says nothing. An element
    that is never closed goes on to the end of the page."""
    out: list[str] = []
    open_: list[str] = []
    many: Counter[str] = Counter()
    hidden = at = 0
    text: list[str] = []  # of one string, which a lone `<` doesn't end
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = MARKUP.match(page, lt)
        if m is None:  # a sign, not markup
            text.append(page[at : lt + 1])
            at = lt + 1
            continue
        if m.end() == lt + 3 and page.startswith("</>", lt):  # nothing at all
            text.append(page[at:lt])
            at = m.end()
            continue
        if not hidden:
            text.append(page[at:lt])
            out.append(decode("".join(text)))
            if m["data"]:
                out.append(m["data"])
        text = []
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if many[name]:
                while True:
                    last = open_.pop()
                    many[last] -= 1
                    hidden -= last in dropped
                    if last == name:
                        break
        elif name not in VOID and not m["empty"]:
            open_.append(name)
            many[name] += 1
            hidden += name in dropped
            if name in RAW:
                close = _RAW_END[name].search(page, at)
                at = close.start() if close else len(page)
    if not hidden:
        text.append(page[at:])
        out.append(decode("".join(text)))
    return " ".join(" ".join(out).split())


@F.arrow_udf(returnType=T.StringType())
def _page_texts(pages: pa.Array) -> pa.Array:
    return pa.array([page_text(p or "") for p in pages.to_pylist()], pa.string())


@F.arrow_udf(returnType=T.StringType())
def _page_texts_closed(pages: pa.Array) -> pa.Array:
    return pa.array([page_text(p or "", decode=closed_references) for p in pages.to_pylist()], pa.string())


def to_text(c, closed: bool = False) -> Column:
    """page_text() of each page, in Arrow batches; null: empty. closed: references end with a semicolon, as title() reads them."""
    return _page_texts_closed(c) if closed else _page_texts(c)


def title(c) -> Column:
    return collapse(unescape(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))
