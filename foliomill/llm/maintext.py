"""HTML extraction: flat text blocks, described by themselves and their neighbours, kept or dropped by a decision tree.

A page is read once from left to right, without a document tree.  Tags that begin or end a block cut the text;
scripts, styles, comments and other raw parts are skipped.  Each block is described by its number of words, its
share of words inside links, the same two numbers of the block before and after, and by marks of the markup around it:
heading, list or table, and the place: in a part that is named or tagged as something else than the article (menu, header,
footer, sidebar, notice, advert, form, reader comments), in ``article``, ``main`` or a part named so, or in neither.  A decision tree, grown on the blocks of a
small labelled table of pages, says which blocks are main text.

A row is one page and is judged by itself, so there is no shuffle; the tree is a few dozen numbers, sent with the task.

Defined cases: a null html is an empty page and has an empty text; a page without main text has an empty text; text
behind a tag that is never closed by ``>`` belongs to that tag; a tag whose quote is never closed ends at the next ``>``; an end tag without a beginning is
ignored; a part left open ends with the page, or with the part around it; very long pages are read in one pass; null and
repeated page_ids, repeated pages and ties need no care, as every row is its own page; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

# Elements by their role in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select", "title", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLANK = {"br", "img", "input", "rt", "rp"}  # what stands before and after is not one word
PARTS = {"nav", "aside", "footer", "header", "form", "dialog", "menu", "button", "fieldset", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "dt", "dd", "td", "th", "caption", "option"}
# Names in class, id or role of parts that are not the article, and of those that hold it.
OTHER = (
    "ad|ads|advert|adverts|advertisement|advertisements|advertising|alert|banner|breadcrumb|breadcrumbs|comment|commentlist|comments|complementary|consent|contentinfo|cookie|cookies|disqus|"
    "footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|pager|pagination|popup|promo|promoted|recommended|related|replies|reply|"
    "respond|reviews|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|tags|teaser|toc|toolbar|widget"
)
BODY = "article|main|content|entry|post|story|body|text"
OTHER_NAME, BODY_NAME = (re.compile(rf"(?:^|[\s_-])(?:{names})\d*(?=$|[\s_-])") for names in (OTHER, BODY))
OTHER_WORD, BODY_WORD = (re.compile(rf"(?:^|\s)(?:{names})(?=$|\s)") for names in (OTHER, BODY))
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<close>>?))",
    re.DOTALL,
)
NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")
LABEL = re.compile(r'data-label="([^"]*)"')

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "list", "place")


def kind_of(name: str, rest: str) -> str:
    """``inside`` for article and main, ``other`` for parts that are not the article, else empty."""
    if name in PARTS or (rest and HIDDEN.search(rest)):
        return "other"
    names = CASES.sub("-", " ".join(n.strip("\"'") for n in NAMES.findall(rest))).lower() if rest else ""
    if name in ("html", "body"):
        return ""
    other, body = OTHER_NAME.search(names), BODY_NAME.search(names) or name in ("article", "main")
    if other and body:
        # A whole word counts more than a part of one: "post has-comments", "sidebar content", "comment-body".
        return "inside" if BODY_WORD.search(names) and not OTHER_WORD.search(names) else "other"
    return "other" if other else "inside" if body else ""


@dataclass
class Block:
    """Words of a block, how many of them stand in links, and the marks around it."""

    words: list[str]
    linked: int
    heading: bool
    listed: bool
    inside: bool
    other: bool
    label: str


@dataclass
class Part:
    """An open element with a mark or a label; ``nested`` counts open elements of its name inside it."""

    name: str
    kind: str
    label_before: str
    nested: int = 0


class Reader:
    """Collects the blocks of one page, tag by tag and text by text."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[Part] = []
        self.places: dict[str, list[int]] = {}  # of the open parts, by name
        self.count = {"inside": 0, "other": 0, "": 0}
        self.label = ""
        self.words: list[str] = []
        self.linked = 0
        self.in_link = self.heading = self.listed = False
        self.glue = False  # the last word and the next text are one word

    def flush(self) -> None:
        if self.words:
            self.blocks.append(Block(self.words, self.linked, self.heading, self.listed, self.count["inside"] > 0, self.count["other"] > 0, self.label))
        self.words, self.linked, self.glue = [], 0, False

    def text(self, raw: str) -> None:
        raw = references.unescape(raw) if "&" in raw else raw
        new = raw.split()
        if not new:
            self.glue = self.glue and not raw
            return
        self.linked += len(new) * self.in_link
        if self.glue and not raw[0].isspace():
            self.words[-1] += new[0]
            del new[0]
        self.words += new
        self.glue = not raw[-1].isspace()

    def start(self, name: str, rest: str) -> None:
        if name in BLANK:
            self.glue = False
        if name == "a":
            self.in_link = "href" in rest.lower()
        if name not in INLINE and name != "input":
            self.flush()
            self.in_link = False
            self.heading = name in HEADINGS
            self.listed = name in ITEMS or (self.listed and name in ("p", "ul", "ol"))
            if self.parts and (self.parts[-1].name == "p" or self.parts[-1].name == name == "li"):
                self.leave(len(self.parts) - 1)  # no end tag needed
        if name in VOID:
            return
        kind = "" if name == "a" else kind_of(name, rest)
        if name in ("article", "main"):
            # A form may hold a whole page, and an unclosed part ends where the main part begins.
            for part in self.parts:
                if part.kind == "other" and (name == "main" or part.name in ("form", "head")):
                    part.kind = ""
                    self.count["other"] -= 1
        label = LABEL.search(rest) if "data-label" in rest else None
        if kind or label:
            self.places.setdefault(name, []).append(len(self.parts))
            self.parts.append(Part(name, kind, self.label))
            self.count[kind] += 1
            self.label = label[1] if label else self.label
        elif self.places.get(name):
            self.parts[self.places[name][-1]].nested += 1

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name not in INLINE:
            self.flush()
            self.in_link = self.heading = False
            self.listed = self.listed and name == "p"
        if self.places.get(name):
            part = self.parts[self.places[name][-1]]
            part.nested -= 1
            if part.nested < 0:
                self.leave(self.places[name][-1])

    def leave(self, upto: int) -> None:
        while len(self.parts) > upto:
            part = self.parts.pop()
            self.places[part.name].pop()
            self.count[part.kind] -= 1
            self.label = part.label_before


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with words as they are shown."""
    reader = Reader()
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        found = TAG.match(page, lt) if lt >= 0 else None
        if found is None:  # plain text, up to the end or with a sign that begins no tag
            upto = lt + 1 if lt >= 0 else end
            reader.text(page[at:upto])
            at = upto
            continue
        if lt > at:
            reader.text(page[at:lt])
        at = found.end()
        if found["end"] is not None:
            reader.end(found["end"].lower())
        elif found["tag"] is not None:
            name, rest = found["tag"].lower(), found["rest"]
            if not found["close"]:
                at = page.find(">", lt) + 1  # a quote that is never closed
                if not at:
                    break  # the page ends inside this tag
                rest = page[found.start("rest") : at - 1]
            if name not in RAW:
                reader.start(name, rest)
            elif not (name in ("svg", "math") and rest.endswith("/")):
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
    reader.flush()
    return reader.blocks


def describe(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; before the first and after the last block stands an empty one."""
    words = np.array([0, *(len(b.words) for b in found), 0], float)
    share = np.array([0, *(b.linked / max(len(b.words), 1) for b in found), 0], float)
    marks = np.array([(b.heading, b.listed, 0 if b.other else 1 + b.inside) for b in found], float).reshape(-1, 3)
    return np.column_stack([words[1:-1], share[1:-1], words[:-2], share[:-2], words[2:], share[2:], marks])


# --- the decision tree ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A binary tree in arrays: feature (-1 at a leaf), threshold (left if at most), children, share of main text."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.share[at] > 0.5
            here = at[inner]
            at[inner] = np.where(x[inner, self.feature[here]] <= self.threshold[here], self.left[here], self.right[here])


def _gini(main: np.ndarray, all_: np.ndarray) -> np.ndarray:
    p = main / np.maximum(all_, 1)
    return 2 * p * (1 - p) * all_


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 3) -> Tree:
    """CART by Gini impurity; of equally good splits the first feature and the lowest threshold."""
    nodes: list[list] = []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        main, n = y[rows].sum(), len(rows)
        best = (float(_gini(main, n)) - 1e-9, -1, 0.0)
        if level < depth and 0 < main < n:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values, hits = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(values[1:] > values[:-1])
                cut = cut[(cut + 1 >= least) & (n - cut - 1 >= least)]
                if len(cut):
                    cost = _gini(hits[cut], cut + 1) + _gini(main - hits[cut], n - cut - 1)
                    k = int(np.argmin(cost))
                    if cost[k] < best[0] - 1e-12:
                        best = (float(cost[k]), f, float(values[cut[k]] + values[cut[k] + 1]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = node(rows[low], level + 1)
            nodes[me][3] = node(rows[~low], level + 1)
        return me

    node(np.arange(len(y)), 0)
    f, t, a, b, s = (np.array(c) for c in zip(*nodes, strict=True))
    return Tree(f.astype(int), t.astype(float), a.astype(int), b.astype(int), s.astype(float))


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages whose parts carry ``data-label`` (main or other)."""
    found = [blocks(p) for p in pages]
    return np.vstack([describe(f) for f in found]), np.array([b.label == "main" for f in found for b in f], float)


def default_tree() -> Tree:
    """The tree of the labelled table of ``maintext_pages``: the same on every machine."""
    from foliomill.llm.maintext_pages import PAGES

    return grow(*labelled(PAGES))


# --- the job ----------------------------------------------------------------------------------------


def main_text(page: str | None, tree: Tree) -> str:
    """The main blocks, in order, two line ends between them."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(describe(found))
    return "\n\n".join(" ".join(b.words) for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [main_text(p.as_py(), tree) for p in html.slice(start, 64)]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op12_maintext(spark, sf_dir: str) -> DataFrame:
    return extract(common.documents(spark, sf_dir, "pages"))
