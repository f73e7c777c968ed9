"""Main-text extraction from HTML by a tree-structured graphical model.

Block elements and text runs of a page are the nodes of a tree; each is content or not.  A node has a unary potential
from its tag, its class and id words, and its text; a parent and its child have a pairwise one.  Messages go up and
down once (sum-product), which gives each node's exact marginal; text runs above one half are the page's text.

Potentials are trained from labelled pages (pairs of html and its main text); ``labelled_pages`` makes a set of them:
pages with and without a named main part, laid out by boxes, tables or line breaks.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: An attribute of a start tag or the tag's end.  Quantifiers are possessive: nothing is scanned twice.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"|\Z)|'([^']*+)('|\Z)|([^\s>]*+)))?)")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
MARKED = frozenset(("class", "id", "role"))
LETTERS = re.compile(r"[a-z]+")
#: Elements whose content is text up to their end tag, and never shown here.
RAW = frozenset("script style noscript iframe title textarea xmp noembed noframes annotation".split())
#: Elements with markup inside that is not shown.  Only svg can be closed by the slash of its own start tag.
HIDDEN = frozenset("template object svg video audio canvas".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these kinds, up to one of the bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",))}
#: Inside p, only these do not end it.
INLINE_BLOCK = frozenset("button select option optgroup".split())
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass
class Node:
    tag: str  # "#" for a text run
    parent: int
    marks: list[str] = field(default_factory=list)
    text: str = ""
    linked: int = 0  # characters inside links
    chars: int = 0  # of the whole subtree
    links: int = 0


def attributes(page: str, at: int) -> tuple[int, list[str], bool]:
    """(where a tag ends, its class, id and role words, whether a slash closes it) from behind its name on; a tag that
    the page's end cuts off ends there."""
    marks: list[str] = []
    while m := ATTRIBUTE.match(page, at):
        if m[1]:
            return m.end(), marks, page[m.end() - 2] == "/"
        at = m.end()
        if m[2] and m[2].lower() in MARKED:
            marks += [f"{m[2].lower()}={w}" for w in LETTERS.findall((m[3] or m[5] or m[7] or "").lower())]
    return len(page), marks, False


class Tree:
    """Open elements and the nodes made so far.  Where each kind is open is kept, so that no tag searches the stack."""

    def __init__(self) -> None:
        self.nodes, self.stack = [Node("#page", -1)], [0]
        self.open: dict[str, list[int]] = {}
        self.chunks: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.chunks:
            text = " ".join("".join(self.chunks).split())
            self.chunks.clear()
            if text:
                n = min(self.linked, len(text))
                self.nodes.append(Node("#", self.stack[-1], text=text, linked=n, chars=len(text), links=n))
        self.linked = 0

    def depth(self, tags: tuple[str, ...]) -> int:
        """The place on the stack of the innermost open element of these kinds (0: none)."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.nodes[self.stack.pop()].tag].pop()

    def start(self, tag: str, marks: list[str]) -> None:
        if tag not in INLINE_BLOCK and self.nodes[self.stack[-1]].tag == "p":
            self.cut(len(self.stack) - 1)
        if tag in CLOSES:
            ends, bounds = map(self.depth, CLOSES[tag])
            if ends > bounds:
                self.cut(ends)
        if tag in VOID:
            return
        self.nodes.append(Node(tag, self.stack[-1], marks))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.nodes) - 1)

    def end(self, tag: str) -> None:
        if depth := self.depth((tag,)):
            self.cut(depth)


def parse(page: str) -> list[Node]:
    """Block elements and text runs in page order, parents before children; node 0 is the page.

    One pass, linear in the page's length.  As in the HTML standard, a slash at the end of a start tag closes it in svg
    only, an unclosed script, style or comment reaches to the page's end, and so does a tag cut off by it.
    """
    tree = Tree()
    hidden: list[str] = []  # open elements of which nothing shows, and how many of each kind
    count: Counter = Counter()
    at, in_link, n = 0, False, len(page)

    def say(raw: str) -> None:
        if raw and not hidden:
            text = html_lib.unescape(raw) if "&" in raw else raw
            tree.chunks.append(text)
            if in_link:
                tree.linked += len(text.strip())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if closing or page.startswith(("!", "?"), lt + 1):
                say(page[at:lt])
                mark = "-->" if page.startswith("<!--", lt) else ">"
                end = page.find(mark, lt + 2)
                at = n if end < 0 else end + len(mark)
            else:  # a character like any other
                say(page[at : lt + 1])
                at = lt + 1
            continue
        say(page[at:lt])
        tag = m[0].lower()
        at, marks, slash = attributes(page, m.end())
        if closing:
            if count[tag]:
                while count[tag := hidden.pop()] and tag != m[0].lower():
                    count[tag] -= 1
                count[tag] -= 1
            elif hidden:
                continue
            elif tag == "a":
                in_link = False
            elif tag == "br":
                tree.chunks.append(" ")
            elif tag in BLOCK:
                tree.flush()
                in_link = False
                tree.end(tag)
        elif tag in RAW:
            found = _ENDS[tag].search(page, at)
            at = attributes(page, found.end())[0] if found else n
        elif hidden and not (hidden[-1] == "svg" and tag in BLOCK):
            if tag == hidden[-1] and not (slash and tag == "svg"):
                hidden.append(tag)
                count[tag] += 1
        else:
            while hidden and hidden[-1] == "svg":  # a block breaks out of it
                count[hidden.pop()] -= 1
            if hidden:
                continue
            if tag in HIDDEN:
                if not (slash and tag == "svg"):
                    hidden.append(tag)
                    count[tag] += 1
            elif tag == "a":
                in_link = True
            elif tag == "br":
                tree.chunks.append(" ")
            elif tag in BLOCK:
                tree.flush()
                in_link = False
                tree.start(tag, marks)
    tree.flush()
    nodes = tree.nodes
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent]
        up.chars += nodes[i].chars
        up.links += nodes[i].links
    return nodes


def bucket(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x >= b for b in bounds)


def features(n: Node, parent: Node, wrapped: bool = False) -> list[str]:
    """What a node's unary potential looks at; ``wrapped``: whether the page names its main part (article or main)."""
    dense = bucket(n.links / n.chars, (0.05, 0.3, 0.7)) if n.chars else -1
    size = bucket(n.chars, (1, 15, 60, 200, 600))
    kind = "text" if n.tag == "#" else "element"
    out = [kind, f"{kind} size={size}", f"{kind} links={dense}", f"{kind} of {wrapped}"]
    if n.tag == "#":
        return [*out, f"in={parent.tag}", f"in={parent.tag} of {wrapped}", f"stop={n.text[-1] in '.!?…'}"]
    return [*out, f"tag={n.tag}", f"tag={n.tag} in={parent.tag}", f"under={parent.tag} of {wrapped}", *{f"mark={w.partition('=')[2]}" for w in n.marks}]


def is_wrapped(nodes: list[Node]) -> bool:
    return any(n.tag in ("article", "main") for n in nodes)


def edge_kind(n: Node) -> int:
    """Which pairwise potential joins a node to its parent: that of elements or that of text runs."""
    return int(n.tag == "#")


@dataclass
class Model:
    weights: dict[str, float]
    pair: np.ndarray  # logarithms of potentials: edge kind x parent x child

    def unaries(self, nodes: list[Node]) -> list[float]:
        """Log-odds of every node by itself; the page has none."""
        weight, wrapped = self.weights.get, is_wrapped(nodes)
        return [0.0, *[sum(weight(f, 0.0) for f in features(n, nodes[n.parent], wrapped)) for n in nodes[1:]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages from the leaves up, then from the page down."""
        pair = np.exp(self.pair).tolist()
        odds = self.unaries(nodes)
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            (p00, p01), (p10, p11) = pair[edge_kind(nodes[i])]
            e = math.exp(max(-30.0, min(30.0, odds[i])))
            up[i] = math.log((p10 + p11 * e) / (p00 + p01 * e))
            odds[nodes[i].parent] += up[i]
        for i in range(1, len(nodes)):  # odds of the parent are its belief by now
            (p00, p01), (p10, p11) = pair[edge_kind(nodes[i])]
            e = math.exp(max(-30.0, min(30.0, odds[nodes[i].parent] - up[i])))
            odds[i] += math.log((p01 + p11 * e) / (p00 + p10 * e))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        return " ".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.tag == "#" and p > 0.5)


def label(nodes: list[Node], content: str) -> list[int]:
    """1 for text runs found in the main text in order, and for elements of whose text half or more is such."""
    at, good, out = 0, [0] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.tag == "#" and (k := content.find(n.text, at)) >= 0 and k <= at + 1:
            out[i], good[i], at = 1, n.chars, k + len(n.text)
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
    return [o or int(n.chars > 0 and 2 * g >= n.chars) for o, n, g in zip(out, nodes, good, strict=True)]


def train(pages: list[tuple[str, str]], rounds: int = 150, rate: float = 0.2, decay: float = 0.3) -> Model:
    """Unary and pairwise potentials of the greatest likelihood of the labels (with a Gaussian prior), by gradients that
    sum-product over all trees at once gives exactly: expected less observed counts.  Steps are Adam's."""
    names: dict[str, int] = {}
    rows, cols, y, parent, level, kind = [], [], [], [], [], []
    for page, content in pages:
        nodes, base = parse(page), len(y)
        labels, wrapped = label(nodes, content), is_wrapped(nodes)
        for i, n in enumerate(nodes):
            for f in features(n, nodes[n.parent], wrapped) if i else ():
                rows.append(len(y))
                cols.append(names.setdefault(f, len(names)))
            y.append(labels[i])
            parent.append(base + n.parent if i else -1)
            level.append(level[base + n.parent] + 1 if i else 0)
            kind.append(edge_kind(n))
    r, c, t, up_of, depth, kinds = (np.array(x) for x in (rows, cols, y, parent, level, kind))
    by_level = [np.flatnonzero(depth == k) for k in range(int(depth.max(initial=0)) + 1)]
    below = np.flatnonzero(depth > 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kinds[below], t[up_of[below]], t[below]), 1)
    x = np.zeros(len(names) + 8)
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, rounds + 1):
        w, pair = x[:-8], x[-8:].reshape(2, 2, 2)
        odds = np.bincount(r, weights=w[c], minlength=len(t)) if len(r) else np.zeros(len(t))
        theta = pair[kinds]
        up = np.zeros(len(t))
        for nodes_at in by_level[:0:-1]:
            th, o = theta[nodes_at], odds[nodes_at]
            up[nodes_at] = np.logaddexp(th[:, 1, 0], th[:, 1, 1] + o) - np.logaddexp(th[:, 0, 0], th[:, 0, 1] + o)
            np.add.at(odds, up_of[nodes_at], up[nodes_at])
        own, cavity = odds.copy(), np.zeros(len(t))
        for nodes_at in by_level[1:]:
            th = theta[nodes_at]
            cavity[nodes_at] = e = odds[up_of[nodes_at]] - up[nodes_at]
            odds[nodes_at] += np.logaddexp(th[:, 0, 1], th[:, 1, 1] + e) - np.logaddexp(th[:, 0, 0], th[:, 1, 0] + e)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        joint = theta[below]
        joint[:, 1, :] += cavity[below, None]
        joint[:, :, 1] += own[below, None]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = np.stack([joint[kinds[below] == k].sum(axis=0) for k in (0, 1)])
        g = np.concatenate([np.bincount(c, weights=(p - t)[r], minlength=len(names)) if len(r) else np.zeros(0), (expected - seen).ravel()]) + decay * x
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x -= rate * (1 - step / (rounds + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(dict(zip(names, x[:-8].tolist(), strict=True)), x[-8:].reshape(2, 2, 2).copy())


def labelled_pages(n: int = 1000, seed: int = 13) -> list[tuple[str, str]]:
    """Pages of varied layout with their main text: the labelled set that the potentials are trained from."""
    rng = random.Random(seed)
    pick = rng.choice
    syllables = "ba be ci co da de fi ga ho in ka la li ma mo ne no pa ra re sa si ta te to un va ve".split()

    def word() -> str:
        return "".join(pick(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(k: int | None = None) -> str:
        return " ".join(word() for _ in range(k or rng.randint(1, 18))).capitalize() + pick("....!?")

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(k))

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def mark(tag: str, names: str, inner: str) -> str:
        chance = rng.random()
        kind = f' {pick(["class", "id", "class"])}="{pick(names.split())}{pick(["", "", "-box", " wide", "-1"])}"' if chance < 0.8 else ""
        return f"<{tag}{kind}>{inner}</{tag}>"

    def divlike(names: str, inner: str) -> str:
        return f'<{(t := pick(["div", "div", "section"]))} {pick(["class", "id"])}="{pick(names.split())}{pick(["", "", "-box", " wide"])}">{inner}</{t}>'

    def noise() -> str:
        said = pick([prose(rng.randint(1, 3)), f"<p>{prose(rng.randint(1, 2))}</p>"])
        return pick([
            lambda: mark("nav", "nav menu navigation breadcrumb", menu()),
            lambda: divlike("menu nav navbar navigation breadcrumbs topnav", menu()),
            lambda: mark("header", "header masthead top site", pick([f"<h1>{sentence(3)}</h1>", f"<a href='/'>{word()}</a>"]) + pick(["", menu()])),
            lambda: mark("footer", "footer bottom foot site", said + pick(["", menu(), f"&copy; {word()} &middot; {sentence(4)}"])),
            lambda: divlike("footer copyright bottom foot", said),
            lambda: mark("aside", "sidebar side related widget", said + pick(["", menu()])),
            lambda: divlike("sidebar related widget side promo recommended popular trending", said + pick(["", menu()])),
            lambda: divlike("ad ads advert advertisement sponsor sponsored banner promo", said),
            lambda: divlike("ad ads advert advertisement sponsored", said),
            lambda: divlike("cookie notice consent banner alert popup modal newsletter subscribe", said + pick(["", f"<button>{word()}</button>"])),
            lambda: mark("form", "form search login subscribe contact", f"<label>{sentence(2)}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{word()}</textarea><button>{word()}</button>"),
            lambda: divlike("comments comment discussion responses replies", "".join(pick(["<div class='comment'>{}</div>", "<p>{}</p>", "<li>{}</li>", "<article class='comment'><p>{}</p></article>"]).format(prose(rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))),
            lambda: divlike("share social tags meta byline pagination pager", menu()),
        ])()

    def plain_box(inner: str) -> str:
        """A box whose names tell nothing."""
        name = pick(["row", "col", "box", "inner", "outer", "block", "layout", "section", "grid", "left", "center", word(), word()])
        return pick([f"<div>{inner}</div>", f'<div class="{name}">{inner}</div>', f'<div id={name}>{inner}</div>', f"<section>{inner}</section>", f"<div class='{name} {word()}'>{inner}</div>"])

    pages = []
    for _ in range(n):
        title, parts, text = sentence(rng.randint(2, 9)), [], []

        def add(markup: str, plain: str, parts: list[str] = parts, text: list[str] = text) -> None:
            parts.append(markup)
            text.append(plain)

        shape = pick(["article"] * 8 + ["main"] * 2 + ["named"] * 6 + ["bare"] * 4 + ["plain"] * 5 + ["table"] * 2 + ["running"] * 2 + ["lone"] * 3)
        run = pick(["{}<br><br>", "{}<br>", "<p>{}", "{}<p>"])
        if rng.random() < (0.4 if shape == "lone" else 0.8):
            h = pick(["h1", "h1", "h2"])
            if shape == "article" and rng.random() < 0.25:
                add(f"<header><{h}>{title}</{h}>", title)
                parts.append(pick(["", mark("div", "byline meta tags", f"{word()} {word()}"), f"<p class=byline>{sentence(3)}</p>"]) + "</header>")
            else:
                add(f"<{h}>{title}</{h}>", title)
        for _ in range(rng.randint(1, 3 if shape == "lone" else 9)):
            s = prose(pick([1, 1, 2, 4, 8]))
            kind = rng.random()
            if shape == "running":
                add(run.format(s), s)
            elif kind < 0.54:
                add(f"<p>{s}" + pick(["</p>", "</p>", "", "<br>"]), s)
            elif kind < 0.64:
                add(f"<p><b>{s}" + pick(["</b></p>", "<br>"]), s)
            elif kind < 0.7:
                add(f"<p>{s} <a href='x'>{(w := word())}</a></p>", f"{s} {w}")
            elif kind < 0.76:
                add(f"<{(h := pick(['h2', 'h2', 'h3', 'h4']))}>{s}</{h}>", s)
            elif kind < 0.82:
                add(*(lambda items: ((t := pick(["ul", "ol"])) and f"<{t}>" + "".join(f"<li>{x}" + pick(["</li>", ""]) for x in items) + f"</{t}>", " ".join(items)))([sentence() for _ in range(rng.randint(1, 6))]))
            elif kind < 0.87:
                add(pick(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><img src=x><figcaption>{}</figcaption></figure>", "<dl><dt>{}</dt></dl>"]).format(s), s)
            elif kind < 0.92:
                add(*(lambda cells: ("<table>" + "".join(f"<tr>{''.join(f'<td>{x}</td>' for x in row)}</tr>" for row in cells) + "</table>", " ".join(x for row in cells for x in row)))([[word() if rng.random() < 0.5 else sentence() for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]))
            elif kind < 0.97:
                add(plain_box(f"<p>{s}</p>"), s)
            else:
                add(f"<div>{s}</div>", s)
            if shape not in ("running", "lone") and rng.random() < 0.06:
                parts.append(noise())
        body = "".join(parts)
        if shape == "article":
            body = pick(["<article>{}</article>", "<article class='post'>{}</article>", "<main><article>{}</article></main>"]).format(body)
        elif shape == "main":
            body = f"<main>{body}</main>"
        elif shape == "named":
            body = divlike("content article post entry main story body text", body)
        elif shape == "plain":
            for _ in range(rng.randint(1, 6)):
                body = plain_box(body)
        elif shape == "table":
            side = pick(["", f"<td>{menu()}</td>"])
            body = f"<table width=100%><tr>{side}<td>{body}</td></tr></table>"
        few = 0 if shape in ("bare", "plain", "running") else 1
        before, after = ("".join(noise() for _ in range(0 if shape == "lone" else rng.randint(few, 4))) for _ in "ba")
        inner = before + body + after
        for _ in range(pick([0, 0, 0, 1, 1, 3])):
            inner = divlike("wrapper container page site wrap", inner) if rng.random() < 0.6 else plain_box(inner)
        end = "" if rng.random() < 0.2 else "</body></html>"
        if shape in ("lone", "running") and rng.random() < 0.5:  # a fragment
            pages.append((inner, " ".join(" ".join(text).split())))
            continue
        pages.append((f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{}}</style></head><body>{inner}{end}", " ".join(" ".join(text).split())))
    return pages


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars (code points).

    A null or empty page, or one without content, has the empty text, and an empty table gives an empty one.  Repeated
    rows are pages in their own right; other columns of those two names are replaced.  A marginal of exactly one half is
    not content.  Pages of any length are parsed whole, in time linear in their length.
    """
    model = model or train(labelled_pages())
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, F.col(html_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(kept)):
            text = [model.extract(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], batch.schema.names)

    return rows.mapInArrow(run, rows.schema).withColumn("n_chars", F.length("text").cast("long"))


def op10_extract_content(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
