"""Main text of web pages by a tree-structured graphical model.

A page is read into its tree of block elements. Every node has a hidden label, content or not, with
a potential from its own features (tag, words of class and id, length, share of link text) and a
potential for each pair of parent and child. Sum-product messages go up and down the tree once and
give every node's exact marginal; the text of nodes whose marginal is over one half is kept.
The potentials are fitted by conditional likelihood on labelled pages (html_labels).

A text run is the text between two block boundaries; inline elements don't break it. Character
references are decoded, white space becomes one space, runs are joined by one space in page order.
Scripts, styles, templates, titles, frames and what forms offer never count; formulas, drawings and what stands in for media do, like
any text. An article's own header (its headline) is part of it, a page's isn't. Reading and judging a page take time in proportion to
its length, whatever is left open or unbalanced in it.

Nulls: a null or empty page has an empty text. A page without markup is one run of body text, judged
like any. Repeated rows give equal results, an empty table no rows. Extra columns are kept by
extract(); those named like a result column are replaced. A page of any length is read whole.
"""

from __future__ import annotations

import functools
import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from citelab.llm import common, html_labels

#: Fixed values of HTML: elements that make blocks, that never have an end, whose text isn't shown.
BLOCK = frozenset("html body main article section header footer nav aside div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre form fieldset figure figcaption address details summary center hgroup dialog menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe textarea select title".split())
#: Fixed values of HTML: what an open element is closed by, and what stops that.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table article section div main body aside nav header footer form blockquote".split())

#: A comment, a declaration or a tag. A value without quotes may hold quotes; nothing is tried twice.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORDS = re.compile(r"[a-z]+")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Block nodes (parent, tag, names, own text, link text) and the text runs in page order."""

    __slots__ = ("attrs", "links", "names", "parents", "runs", "tags", "texts")

    def __init__(self, source: str) -> None:
        self.parents, self.tags, self.names, self.attrs = [-1], ["root"], [()], [""]
        self.texts, self.links = [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]  # open elements and the block node each is in
        open_at: dict[str, list[int]] = {}  # where each tag is open in the stack
        blocks = [0]  # where blocks are
        run: list[str] = []
        at, end, last = 0, len(source), source.rfind(">")

        def text(to: int) -> None:
            if to > at:
                raw = source[at:to]
                piece = html.unescape(raw) if "&" in raw else raw
                run.append(piece)
                n = len(piece) - piece.count(" ")
                node = stack[-1][1]
                self.texts[node] += n
                if open_at.get("a"):
                    self.links[node] += n

        def close_run() -> None:
            if run:
                joined = " ".join("".join(run).split())
                if joined:
                    self.runs.append((stack[-1][1], joined))
                run.clear()

        def place(tag: str) -> int:
            return (open_at.get(tag) or (0,))[-1]

        def pop(k: int) -> None:
            if blocks[-1] >= k:
                close_run()
            while len(stack) > k:
                tag, _ = stack.pop()
                open_at[tag].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()

        def push(tag: str, node: int) -> None:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))

        while at < end:
            m = TOKEN.search(source, at) if at <= last else None
            if m is None:
                text(end)
                break
            text(m.start())
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if tag == "head":
                continue
            if m[1]:
                k = place(tag)
                if k and (tag in BLOCK or k > blocks[-1]):
                    pop(k)
                continue
            if tag == "br" or tag == "hr":
                run.append(" ")
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in HIDDEN:
                closing = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = closing.end() if closing else end
                continue
            if tag in BLOCK:
                if tag != "html" and tag != "body" and stack[blocks[-1]][0] == "p":  # a block ends a paragraph that is open
                    pop(blocks[-1])
                if tag in CLOSED_BY:
                    k = max(place(t) for t in CLOSED_BY[tag])
                    if k > max(place(t) for t in STOPS):
                        pop(k)
                close_run()
                self.parents.append(stack[-1][1])
                self.tags.append(tag)
                self.attrs.append(m[3])
                self.names.append(self._names(m[3]) if m[3].strip() else ())
                self.texts.append(0)
                self.links.append(0)
                blocks.append(len(stack))
                push(tag, len(self.parents) - 1)
            else:
                push(tag, stack[-1][1])
        close_run()

    @staticmethod
    def _names(raw: str) -> tuple[str, ...]:
        """Words of class, id and role."""
        out: list[str] = []
        for key, value in ATTRIBUTE.findall(raw):
            if key.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                out += [w.lower() for w in NAMES.findall(value)]
            elif key.lower() in ("hidden", "aria-hidden"):
                out.append("hidden")
        return tuple(out)


def node_features(page: Page) -> list[list[str]]:
    n = len(page.parents)
    total, links, inside, prose, linked = list(page.texts), list(page.links), [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        above = page.parents[i]
        total[above] += total[i]
        links[above] += links[i]
        inside[above] += 1
        prose[above] += page.tags[i] in PROSE and page.texts[i] - page.links[i] >= 20
        linked[above] += total[i] > 0 and links[i] > 0.6 * total[i]
    # where on the page a node's text lies, and how much of the page's text without links it is
    before, at, plain = [0] * n, 0, max(1, total[0] - links[0])
    for i in range(n):
        before[i] = at
        at += page.texts[i]
    out = []
    for i in range(n):
        share = links[i] / total[i] if total[i] else 0
        own = page.texts[i]
        f = ["tag " + page.tags[i], "link " + ("0" if not links[i] else "few" if share < 0.3 else "half" if share < 0.7 else "most"), "own " + ("0" if not own else "short" if own < 25 else "line" if own < 120 else "long")]
        part = (total[i] - links[i]) / plain
        size = "0" if not part else "little" if part < 0.05 else "some" if part < 0.25 else "much" if part < 0.6 else "most"
        place = "first" if before[i] < 0.15 * total[0] else "last" if before[i] + total[i] > 0.95 * total[0] else "middle"
        f += [f"part {size}", f"part {size} {place} " + ("linked" if share > 0.6 else "text"), f"own part {size} {page.tags[i]}" if own else "own part 0"]
        f += ["name " + w for w in page.names[i]]
        if i:
            above = page.tags[page.parents[i]]
            f.append(f"tag {page.tags[i]} in {'body' if above in ('root', 'html') else above}")  # html and body may be left out
            f += ["in name " + w for w in page.names[page.parents[i]]]
            if not page.names[i]:
                f.append("no name " + page.tags[i])
            p = page.parents[i]
            f.append(f"in prose {min(prose[p], 3)} linked {min(linked[p], 2)} " + ("short" if total[i] - links[i] < 20 else "text"))
        if inside[i]:
            f.append("parent of " + ("few" if inside[i] < 3 else "many"))
            f.append(f"prose {min(prose[i], 3)} linked {min(linked[i], 2)}")
        out.append(f)
    return out


PROSE = frozenset("p h1 h2 h3 h4 blockquote pre".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption caption".split())


def messages(parents: list[int], unary: list[float], pair: list[list[list[float]]], kind: list[int]) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of content at every node given the page, those below it, and what its parent's side says without it."""
    n = len(parents)
    below = list(unary)
    up = [0.0] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        (p00, p01), (p10, p11) = pair[kind[i]]
        b = below[i]
        up[i] = _lse(p10, p11 + b) - _lse(p00, p01 + b)
        below[parents[i]] += up[i]
    full, side = list(below), [0.0] * n
    for i in range(1, n):
        (p00, p01), (p10, p11) = pair[kind[i]]
        side[i] = q = full[parents[i]] - up[i]
        full[i] = below[i] + _lse(p01, p11 + q) - _lse(p00, p10 + q)
    return full, below, side


def _lse(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b - a > -40 else a


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


class Model:
    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]

    def unary(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in fs) for fs in features]

    def log_odds(self, page: Page) -> list[float]:
        return messages(page.parents, self.unary(node_features(page)), self.pair, [int(t in FLOW) for t in page.tags])[0]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        odds = self.log_odds(page)
        return " ".join(t for node, t in page.runs if odds[node] > 0)


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def fit(labelled: list[str], steps: int = 150, rate: float = 0.5, ridge: float = 2e-4) -> Model:
    """A model of pages whose content blocks carry the attribute data-y (1 or 0); a block without it has its parent's label.

    Conditional likelihood by AdaGrad; the messages of all pages are passed together, depth by depth.
    """
    parents, kind, goal, depth, node, name = [], [], [], [], [], []
    names: dict[str, int] = {}
    for source in labelled:
        page, base = Page(source), len(parents)
        y = [int(len(page.parents) == 1)] * len(page.parents)
        deep = [0] * len(page.parents)
        for i in range(1, len(y)):
            m = re.search(r'data-y="([01])"', page.attrs[i])
            y[i] = int(m[1]) if m else y[page.parents[i]]
            deep[i] = deep[page.parents[i]] + 1
        for i, fs in enumerate(node_features(page)):
            node += [base + i] * len(fs)
            name += [names.setdefault(f, len(names)) for f in fs]
        parents += [base + p if p >= 0 else -1 for p in page.parents]
        kind += [int(t in FLOW) for t in page.tags]
        goal += y
        depth += deep
    parents, kind, goal, depth, node, name = (np.array(x) for x in (parents, kind, goal, depth, node, name))
    n = len(parents)
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    below_root = np.flatnonzero(parents >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[below_root], goal[parents[below_root]], goal[below_root]), 1)
    w, pair = np.zeros(len(names)), np.zeros((2, 2, 2))
    w_sum, pair_sum = np.zeros_like(w), np.zeros_like(pair)
    for _ in range(steps):
        below = np.bincount(node, weights=w[name], minlength=n)
        up, side = np.zeros(n), np.zeros(n)
        for at in reversed(levels):
            p, b = pair[kind[at]], below[at]
            up[at] = _soft(p[:, 1, 0], p[:, 1, 1] + b) - _soft(p[:, 0, 0], p[:, 0, 1] + b)
            np.add.at(below, parents[at], up[at])
        full = below.copy()
        for at in levels:
            p = pair[kind[at]]
            side[at] = q = full[parents[at]] - up[at]
            full[at] = below[at] + _soft(p[:, 0, 1], p[:, 1, 1] + q) - _soft(p[:, 0, 0], p[:, 1, 0] + q)
        wrong = goal - 1 / (1 + np.exp(-np.clip(full, -500, 500)))
        grad = np.bincount(name, weights=wrong[node], minlength=len(names)) / len(labelled) - ridge * w
        at = below_root
        logs = pair[kind[at]] + side[at][:, None, None] * np.array([0, 1])[None, :, None] + below[at][:, None, None] * np.array([0, 1])[None, None, :]
        logs = np.exp(logs - logs.max(axis=(1, 2), keepdims=True))
        logs /= logs.sum(axis=(1, 2), keepdims=True)
        expected = np.stack([logs[kind[at] == k].sum(0) for k in range(2)])
        pair_grad = (seen - expected) / len(labelled) - ridge * pair
        w_sum += grad * grad
        pair_sum += pair_grad * pair_grad
        w += rate * grad / np.sqrt(w_sum + 1e-9)
        pair += rate * pair_grad / np.sqrt(pair_sum + 1e-9)
    model = Model()
    model.weights = {f: float(w[i]) for f, i in names.items()}
    model.pair = pair.tolist()
    return model


@functools.cache
def default_model() -> Model:
    """The model of html_labels' pages, fitted once in a process."""
    return fit(html_labels.pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages with text and n_chars (code points)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def fn(batch):
        texts = [sent.value.text(x.as_py()) for x in common.column(batch, "html")]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return common.annotate(pages, "html", [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], fn)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
