"""Pages as a relation of nodes: one parse a page, then joins and aggregates instead of tree walks.

A node's descendants are the nodes of its page with `pre` above its own and `post` below its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, and which open elements a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

SCHEMA = "page_id long, node_id int, parent_id int, pre int, post int, depth int, tag string, attrs map<string,string>, classes array<string>, own_text string, text string, n_children int"


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.clock = 0
        self.pieces: list[str] = []  # the visible text, in document order

    def _start(self, tag: str, attrs: list) -> int:
        for wanted in (CLOSES.get(tag),):
            while wanted and self.open:
                k = next((i for i in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[i]]["tag"] in wanted), None)
                barrier = next((i for i in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[i]]["tag"] in _STOPS.get(tag, set())), -1)
                if k is None or k < barrier:
                    break
                self._close_to(k)
        i = len(self.nodes)
        self.clock += 1
        parent = self.open[-1] if self.open else None
        if parent is not None:
            self.nodes[parent]["n_children"] += 1
        self.nodes.append({"parent": parent, "pre": self.clock, "post": 0, "depth": len(self.open), "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "own": [], "n_children": 0, "end": 0, "said": (len(self.pieces), 0)})
        return i

    def _close_to(self, k: int) -> None:
        while len(self.open) > k:
            self.clock += 1
            n = self.nodes[self.open.pop()]
            n["post"], n["end"], n["said"] = self.clock, len(self.nodes), (n["said"][0], len(self.pieces))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open.append(self._start(tag, attrs))
        if tag in VOID:
            self._close_to(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open.append(self._start(tag, attrs))
        self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        k = next((i for i in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[i]]["tag"] == tag), None)
        if k is not None:
            self._close_to(k)

    def handle_data(self, data: str) -> None:
        if self.open:
            n = self.nodes[self.open[-1]]
            n["own"].append(data)
            if n["tag"] not in ("script", "style") and (said := " ".join(data.split())):
                self.pieces.append(said)


# Plain markup, which needs no tolerant parser: text, end tags, start tags whose values are quoted, a doctype, comments.
_PLAIN = re.compile(
    r"""([^<]++)|</([a-zA-Z][a-zA-Z0-9-]*+)>|<([a-zA-Z][a-zA-Z0-9-]*+)((?:[ \n]++[a-zA-Z][a-zA-Z0-9_:-]*+(?:="[^"]*+"|='[^']*+')?+)*+)[ \n]*+(/?+)>|<!(?i:doctype)[^<>\[]*+>|<!--[^<>-]*+-->"""
)
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:-]*+)(?:=(?:"([^"]*+)"|'([^']*+)'))?+""")
_ENDS = {tag: re.compile(f"</{tag}>", re.I) for tag in ("script", "style")}


def _plain(html: str) -> _Tree | None:
    """The tree of a page that is plain markup throughout, as the tolerant parser builds it; None for any other page."""
    tree, at, n = _Tree(), 0, len(html)
    token = _PLAIN.match
    while at < n:
        m = token(html, at)
        if m is None:
            return None
        at = m.end()
        said, ended, tag, attrs, closed = m.groups()
        if said:
            tree.handle_data(unescape(said) if "&" in said else said)
        elif ended:
            tree.handle_endtag(ended.lower())
        elif tag:
            tag = tag.lower()
            found = [(k.lower(), unescape(v) if "&" in v else v) for k, a, b in _ATTR.findall(attrs) for v in (a or b,)] if attrs else []
            if closed:
                tree.handle_startendtag(tag, found)
                continue
            tree.handle_starttag(tag, found)
            if tag in _ENDS:
                end = _ENDS[tag].search(html, at)
                source = html[at : end.start()] if end else "<"
                if "</" in source or "<!" in source or source == "<":
                    return None
                if source:
                    tree.handle_data(source)
                tree.handle_endtag(tag)
                at = end.end()
    return tree


def parse(html: str) -> tuple[list[dict], list[str]]:
    """Nodes in document order and the pieces of visible text; unclosed elements end with the page.

    A node's `said` is its range of pieces, `end` the number of the node after its last descendant.
    """
    tree = _plain(html or "")
    if tree is None:
        tree = _Tree()
        tree.feed(html)
        tree.close()
    tree._close_to(0)
    for i, n in enumerate(tree.nodes):
        n["id"] = i
        n["own_text"] = "".join(n["own"]) if n["tag"] in ("script", "style") else " ".join(" ".join(n["own"]).split())
    return tree.nodes, tree.pieces


#: Text of nodes that is put into one batch, and nodes, of one page or several: an ancestor's text holds that of all below it.
BATCH_CHARS, BATCH_NODES = 4 << 20, 4096


def nodes(pages: DataFrame) -> DataFrame:
    """The nodes of all pages (page_id, html). A script's own_text is its source; `text` leaves scripts and styles out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, held = [], 0
        for b in batches:
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                found, pieces = parse(html)
                for n in found:
                    text = " ".join(pieces[slice(*n["said"])])
                    rows.append((page, n["id"], n["parent"], n["pre"], n["post"], n["depth"], n["tag"], list(n["attrs"].items()), n["attrs"].get("class", "").lower().split(), n["own_text"], text, n["n_children"]))
                    held += len(text) + len(n["own_text"])
                    if held > BATCH_CHARS or len(rows) == BATCH_NODES:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)


def attr(name: str) -> F.Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def inside(nodes_: DataFrame, outer: F.Column) -> DataFrame:
    """The nodes below (or at) a node that satisfies `outer`, by an interval semi-join on their page."""
    o = nodes_.where(outer).select(F.col("page_id").alias("_p"), F.col("pre").alias("_a"), F.col("post").alias("_b"))
    return nodes_.join(o, (F.col("page_id") == F.col("_p")) & (F.col("pre") >= F.col("_a")) & (F.col("post") <= F.col("_b")), "left_semi")


def outside(nodes_: DataFrame, outer: F.Column) -> DataFrame:
    """The nodes that no node satisfying `outer` holds."""
    o = nodes_.where(outer).select(F.col("page_id").alias("_p"), F.col("pre").alias("_a"), F.col("post").alias("_b"))
    return nodes_.join(o, (F.col("page_id") == F.col("_p")) & (F.col("pre") >= F.col("_a")) & (F.col("post") <= F.col("_b")), "left_anti")


CHROME_TAGS = ["nav", "header", "footer", "aside", "menu"]


def in_chrome() -> F.Column:
    """Elements of a site's frame."""
    return F.col("tag").isin(CHROME_TAGS)


FRAME_MARKS = [
    "breadcrumb", "crumb", "sidebar", "side-bar", "navbar", "nav-bar", "nav-menu", "nav-item", "navigation", "menu-item", "menuitem", "filter", "facet",
    "footer", "header", "banner", "announcement", "dropdown", "flyout", "mega-menu", "pagination", "pager",
]
FRAME_LEVELS = 10


def in_frame(nodes_: DataFrame) -> DataFrame:
    """The nodes with `framed`: whether one of the next ten ancestors below the body is part of the site's frame, by tag, classes or id."""
    marks = F.concat_ws(" ", F.array_join("classes", " "), F.lower(attr("id")))
    frame = nodes_.where((in_chrome() | marks.rlike("|".join(FRAME_MARKS))) & ~F.col("tag").isin("body", "html"))
    outer = frame.select(F.col("page_id").alias("_p"), F.col("pre").alias("_a"), F.col("post").alias("_b"), F.col("depth").alias("_d"))
    near = (F.col("page_id") == F.col("_p")) & (F.col("pre") > F.col("_a")) & (F.col("post") < F.col("_b")) & (F.col("depth") - F.col("_d") <= FRAME_LEVELS)
    held = nodes_.join(outer, near, "left_semi").select("page_id", "node_id", F.lit(True).alias("_held"))
    return nodes_.join(held, ["page_id", "node_id"], "left").withColumn("framed", F.coalesce("_held", F.lit(False))).drop("_held")


def links(nodes_: DataFrame) -> DataFrame:
    """page_id, pre, href and text of links that lead somewhere."""
    href = F.trim(attr("href"))
    found = nodes_.where((F.col("tag") == "a") & (href != "") & ~F.lower(href).rlike(r"^(mailto:|tel:|javascript:|#)"))
    return found.select("page_id", "pre", href.alias("href"), "text")


def highest_page_button(nodes_: DataFrame) -> DataFrame:
    """page_id and the highest number of at least two numeric buttons inside an element of pagination."""
    marks = F.concat_ws(" ", F.array_join("classes", " "), F.lower(attr("id")))
    holder = marks.rlike("pagination|pager|pages|page-nav|paginate")
    number = F.col("text").try_cast("int")
    found = inside(nodes_, holder).where(F.col("tag").isin("a", "button", "span", "li") & F.col("text").rlike(r"^\d{1,5}$"))
    return found.groupBy("page_id").agg(F.max(number).alias("highest"), F.countDistinct(number).alias("n")).where("n >= 2").select("page_id", "highest")


def next_links(nodes_: DataFrame) -> DataFrame:
    """page_id and the href of the next page: rel=next, else an aria-label, else the link's text; the first of the first kind."""
    label, text = F.lower(attr("aria-label")), F.lower(F.trim(F.col("text")))
    tier = F.when(F.lower(attr("rel")) == "next", 0).when(F.contains(label, F.lit("next")), 1).when(text.isin("next", "next page", "next >", "next »", ">", "»", "›"), 2)
    found = nodes_.where(F.col("tag").isin("a", "link") & (attr("href") != "")).select("page_id", attr("href").alias("href"), tier.alias("tier"), "pre").where("tier is not null")
    return found.groupBy("page_id").agg(F.min_by("href", F.struct("tier", "pre")).alias("next_href"), F.min("tier").alias("tier"))
