"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements with its text blocks as leaves. Every node is content or not. Its
potential judges what the node itself shows: its own name, tag, text and links, never those of what holds it. A potential on
every edge, by the kind of child (text, nameless block, named block), couples it with its parent, so only messages carry
what a block's ancestors, children and siblings say. They pass from the leaves to the root and back (sum-product),
exactly and for all pages of a batch at once, level by level; a text block whose marginal of being content is above
one half is kept.

Both potentials are trained together, by gradients from the marginals of nodes and edges, on labelled pages. Pages
label themselves where they mark up an article: a text block is content if it stands inside ``article`` or ``main``
and in no part named as navigation, header, footer, advert and so on. Each also trains a copy without names, so that
pages that name nothing are judged by their shape. At most ``SAMPLE`` pages train, chosen by a hash, all nodes of each,
as long as these are ``NODES`` together; a page with more nodes than that does not train.

Markup that is no text (scripts, styles, forms' controls, the head, comments) never becomes a block.
Character references are decoded, white space inside a block becomes one space, blocks are joined in page
order by two new lines.

Defined cases: null and empty pages, and pages without content, have an empty text; unclosed tags end where
their parent does; without a labelled page the names and the edges' prior decide; repeated pages are judged each; an
empty table gives an empty result; a result whose name the input has already is lengthened by an underscore. A page,
however long, is a tree of its own and is read by one task.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.text import free_name, hashed_sample, whole
from larder.session import materialise

SAMPLE, NODES = 300, 100_000  # pages that train, and their nodes
STEPS, RATE, RIDGE = 100, 0.15, 0.5  # of the training, and how far the priors hold
STIFF = 100.0  # the same for features that few pages tell apart from others: a list is judged by its links and its surroundings
#: HTML's own lists and the names pages commonly use (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style head title template noscript svg math iframe object canvas select textarea button option audio video".split())
RAW = frozenset("script style title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
GOOD = frozenset("article main content entry post story body text page".split())
BAD = frozenset("nav navigation navbar menu header footer aside sidebar ad ads advert advertisement banner promo sponsor sponsored comment comments respond reply cookie consent notice alert popup modal overlay form login signup subscribe newsletter share sharing social related recommended widget breadcrumb breadcrumbs pagination pager toolbar copyright legal disclaimer search".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PARTS = re.compile(r"[a-z]+")
FEATURES = ("one", "good", "bad", "leaf", "heading", "list", "paragraph", "children", "log_chars", "links", "ends", "short", "copyright", "top")
HEADINGS, LISTS, PARAGRAPHS = (frozenset(names.split()) for names in ("h1 h2 h3 h4 h5 h6", "ul ol li menu select table dl", "p blockquote pre"))
TEXT, BLOCK, NAMED, TOP = range(4)  # kinds of children, by which the edges differ; a top block stands in the body itself


class Page:
    """The block tree of a page: parallel lists over nodes, parents before children. Leaves carry text."""

    def __init__(self):
        self.parent, self.good, self.bad, self.tag, self.text, self.linked = [-1], [0], [0], [""], [None], [0]

    def add(self, parent: int, tag: str, good: int = 0, bad: int = 0, text: str | None = None, linked: int = 0) -> int:
        for values, value in ((self.parent, parent), (self.good, good), (self.bad, bad), (self.tag, tag), (self.text, text), (self.linked, linked)):
            values.append(value)
        return len(self.parent) - 1


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # open elements with the block node they stand in
    runs: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(runs)).split()) if runs else ""
        if text:
            page.add(stack[-1][1], "", text=text, linked=min(linked, len(text)))
        runs.clear()
        linked = 0

    def close(names, upto=()) -> None:
        """End the nearest open element of ``names``, unless one of ``upto`` is nearer."""
        nonlocal links
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                links -= sum(name == "a" for name, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in upto:
                return

    while at < len(source):
        match = TOKEN.match(source, at)
        if match is None:  # a tag that never ends
            runs.append(source[at])
            at += 1
            continue
        at = match.end()
        end, name, attributes, text = match.groups()
        if text is not None:
            runs.append(text)
            if links > 0:
                linked += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if end:
            if name in INLINE:
                for k in range(len(stack) - 1, 0, -1):  # an inline end tag does not reach over a block
                    if stack[k][0] == name:
                        links -= name == "a"
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                close((name,))
            continue
        if name == "br":
            runs.append(" ")
        if name in SILENT:
            if name not in INLINE:
                flush()
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            # Without an end, text-only elements swallow the rest, others are ignored.
            at = stop.end() if stop else len(source) if name in RAW else at
            continue
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in CLOSES_P:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            links += name == "a"
            stack.append((name, stack[-1][1]))
            continue
        if name in CLOSES_P:
            close(("p",), ("table", "td", "th", "button"))
        if name in SAME:
            close(SAME[name], HOLDS[name])
        flush()
        marks = {w for m in NAMES.findall(attributes) for w in PARTS.findall("".join(m).lower())} | {name} if name not in ("html", "body") else set()
        stack.append((name, page.add(stack[-1][1], name, len(marks & GOOD), len(marks & BAD))))
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """What each node shows by itself."""
    n = len(page.parent)
    x = np.zeros((n, len(FEATURES)), np.float32)
    x[:, 0], x[:, 1], x[:, 2] = 1, np.array(page.good) > 0, np.array(page.bad) > 0
    x[:, 7] = np.log1p(np.bincount(np.maximum(page.parent, 0), minlength=n))
    for k, (tag, text) in enumerate(zip(page.tag, page.text)):
        if text is None:
            x[k, 13] = page.tag[page.parent[k]] in ("body", "html", "") if k else 1
            x[k, 4:7] = tag in HEADINGS, tag in LISTS, tag in PARAGRAPHS
        else:
            x[k, 3], x[k, 7:13] = 1, (0, np.log1p(len(text)) / 5, page.linked[k] / len(text), text[-1] in ".!?…。:\"'»”)", len(text) < 25, "©" in text)
    return x


def kinds(x: np.ndarray) -> np.ndarray:
    """How each node hangs on its parent."""
    return np.where(x[:, 3] > 0, TEXT, np.where(x[:, 13] > 0, TOP, np.where(x[:, 1] + x[:, 2] > 0, NAMED, BLOCK)))


def own_labels(page: Page) -> np.ndarray | None:
    """Content or not of every node by the page's own article markup; None where it has none."""
    n = len(page.parent)
    inside, bad = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, n):
        inside[k] = inside[page.parent[k]] or page.tag[k] in ("article", "main")
        bad[k] = bad[page.parent[k]] or (page.bad[k] > 0 and page.tag[k] not in ("article", "main"))
    if not inside.any():
        return None
    size = np.array([0 if t is None else len(t) for t in page.text])
    total, kept = size.copy(), np.where(inside & ~bad, size, 0)
    for k in range(n - 1, 0, -1):
        total[page.parent[k]] += total[k]
        kept[page.parent[k]] += kept[k]
    return 2 * kept > total


class Model:
    """Weights of the node potential and the logarithmic edge potentials (kind of child, parent, child)."""

    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def messages(self, x: np.ndarray, kind: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node: its belief, what its subtree says, and what its parent hears from all but it (unnormalised logarithms)."""
        below = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        order = np.argsort(depth, kind="stable")
        level = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        up, above, edge = np.zeros((len(x), 2)), np.zeros((len(x), 2)), self.edge[kind]
        for d in range(len(level) - 2, 0, -1):
            rows = order[level[d] : level[d + 1]]
            up[rows] = np.logaddexp(below[rows, 0][:, None] + edge[rows, :, 0], below[rows, 1][:, None] + edge[rows, :, 1])
            np.add.at(below, parent[rows], up[rows])
        belief = below.copy()
        for d in range(1, len(level) - 1):
            rows = order[level[d] : level[d + 1]]
            above[rows] = belief[parent[rows]] - up[rows]
            belief[rows] += np.logaddexp(above[rows, 0][:, None] + edge[rows, 0], above[rows, 1][:, None] + edge[rows, 1])
        return belief, below, above

    def marginals(self, x: np.ndarray, kind: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """P(content) of every node of a forest, by messages to the roots and back."""
        belief = self.messages(x, kind, parent, depth)[0]
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, parent: np.ndarray, depth: np.ndarray, prior: Model, steps: int = STEPS) -> Model:
        """Node and edge potentials by ridge ascent of the labels' likelihood around ``prior``: observed less expected counts."""
        x, kind, y = x.astype(float), kinds(x), y.astype(int)
        child = np.flatnonzero(parent >= 0)
        observed = np.zeros_like(prior.edge)
        np.add.at(observed, (kind[child], y[parent[child]], y[child]), 1)
        at = [prior.weights.copy(), prior.edge.copy()]
        hold = np.where(np.isin(FEATURES, ("list", "short", "ends")), STIFF, RIDGE)
        mean, square = [np.zeros_like(v) for v in at], [np.zeros_like(v) for v in at]
        for step in range(1, steps + 1 if len(x) else 1):
            model = cls(*at)
            belief, below, above = model.messages(x, kind, parent, depth)
            p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
            joint = above[child][:, :, None] + model.edge[kind[child]] + below[child][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            expected = np.zeros_like(observed)
            np.add.at(expected, kind[child], joint / joint.sum(axis=(1, 2), keepdims=True))
            gradients = [x.T @ (y - p) - hold * (at[0] - prior.weights), observed - expected - RIDGE * (at[1] - prior.edge)]
            for k, g in enumerate(gradients):  # steps scaled by the running size of each gradient
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
                at[k] = at[k] + RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        return cls(*at)


#: Where training says little, names decide, and what stands in a block goes with it: content names for, boilerplate names against.
ALIKE = np.array([[2.0, -2.0], [-2.0, 2.0]])
PRIOR = Model(np.array([-0.3, 5.0, -7.0, 0.0, 0.5, -0.5, 1.0, 0.0, 0.8, -2.0, 0.3, -0.3, -2.0, 0.0]), np.stack([ALIKE, ALIKE, ALIKE / 3, ALIKE / 10]))


def forest(trees: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first node of each, parent, depth) of trees, given by their nodes' parents, put one after another."""
    first = np.cumsum([0, *map(len, trees)])
    parent = np.concatenate([np.where(t >= 0, t + a, -1) for t, a in zip(trees, first)]) if trees else np.zeros(0, np.int64)
    depth = np.zeros(len(parent), np.int64)
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[k] = depth[p] + 1
    return first, parent, depth


def train(pages: DataFrame, page_id: str = "page_id", source: str = "html", sample: int = SAMPLE, nodes: int = NODES) -> Model:
    # The share of the hash is one of the pages with article markup, so as many train however many others there are.
    some = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{source}`").alias("html"))
    marked = some.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    chosen = hashed_sample(marked, sample, marked.count(), "id", spare=4.0).select("html")

    def run(frames):
        import pandas as pd

        for got in frames:
            rows = []
            for source in got["html"]:
                page = parse(source)
                labels = own_labels(page)
                if labels is not None and len(labels) <= nodes:
                    rows.append((str(len(labels)).zfill(9) + source[:200], len(labels), features(page).tobytes(), np.array(page.parent, np.int32).tobytes(), labels.tobytes()))
            yield pd.DataFrame(rows, columns=["mark", "n", "x", "parent", "y"])

    parsed = materialise(chosen.repartition(8).mapInPandas(run, "mark string, n int, x binary, parent binary, y binary"))
    order = Window.orderBy(F.xxhash64("x", "y"), "mark").rowsBetween(Window.unboundedPreceding, 0)  # at most `sample` rows
    rows = sorted(parsed.withColumn("sum", F.sum("n").over(order)).filter(F.col("sum") <= nodes).select("mark", "x", "parent", "y").collect())
    if not rows:
        return PRIOR
    trees = [np.frombuffer(r["parent"], np.int32) for r in rows]
    named = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in rows])
    bare, y = named.copy(), np.concatenate([np.frombuffer(r["y"], bool) for r in rows])
    bare[:, 1:3] = 0
    _, parent, depth = forest([*trees, *trees])
    return Model.fit(np.concatenate([named, bare]), np.concatenate([y, y]), parent, depth, PRIOR)


def extract(pages: DataFrame, model: Model, source: str = "html", name: str = "text") -> DataFrame:
    """The other columns of ``pages`` and the main text."""
    keep = [c for c in pages.columns if c != source]
    name = free_name(pages, name)

    def texts(sources: list[str]) -> list[str]:
        trees = [parse(s) for s in sources]
        first, parent, depth = forest([np.array(t.parent) for t in trees])
        x = np.concatenate([features(t) for t in trees])
        p = model.marginals(x, kinds(x), parent, depth)
        return ["\n\n".join(text for text, q in zip(t.text, p[a : a + len(t.text)]) if text is not None and q > 0.5) for t, a in zip(trees, first)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sources = batch.column(batch.num_columns - 1).to_pylist()
            found = [t for a in range(0, len(sources), 500) for t in texts(sources[a : a + 500])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*keep, name])

    out = T.StructType([*[pages.schema[c] for c in keep], T.StructField(name, T.StringType())])
    return pages.select(*[F.col(f"`{c}`") for c in keep], whole(F.col(f"`{source}`")).alias("~html")).mapInArrow(run, out)


def main_text(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """``pages`` without the source, with text and n_chars."""
    found, text = extract(pages, train(pages, page_id, source), source), free_name(pages, "text")
    return found.withColumn(free_name(pages, "n_chars"), F.char_length(F.col(f"`{text}`")).cast("long"))
