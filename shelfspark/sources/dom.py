"""One page as a tree in a Python worker, for rules that look at a few nodes in turn rather than at all by joins."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import wraps
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from .nodes import parse

#: Rows and characters, of one page or several, that are put into one batch.
BATCH_ROWS, BATCH_CHARS = 1000, 4 << 20


class Page:
    """Nodes by number, in document order; -1 is the page itself."""

    def __init__(self, html: str | None):
        self.nodes, self.pieces = parse(html or "")
        self.kept: dict = {}  # what rules have found out about nodes
        self._tags: dict[str, list[int]] | None = None
        self._attrs: dict[str, list[int]] = {}

    def below(self, i: int = -1) -> range:
        """Everything inside a node."""
        return range(i + 1, self.nodes[i]["end"] if i >= 0 else len(self.nodes))

    def kids(self, i: int) -> list[int]:
        out, k = [], i + 1
        end = self.nodes[i]["end"] if i >= 0 else len(self.nodes)
        while k < end:
            out.append(k)
            k = self.nodes[k]["end"]
        return out

    def up(self, i: int) -> Iterator[int]:
        """Ancestors, the nearest first."""
        while (i := self.parent(i)) >= 0:
            yield i

    def parent(self, i: int) -> int:
        p = self.nodes[i]["parent"]
        return -1 if p is None else p

    def after(self, i: int) -> int | None:
        """The next sibling."""
        k, p = self.nodes[i]["end"], self.parent(i)
        return k if k < (self.nodes[p]["end"] if p >= 0 else len(self.nodes)) else None

    def tag(self, i: int) -> str:
        return self.nodes[i]["tag"]

    def attr(self, i: int, name: str) -> str:
        return self.nodes[i]["attrs"].get(name, "").strip()

    def has(self, i: int, name: str) -> bool:
        return name in self.nodes[i]["attrs"]

    def classes(self, i: int) -> str:
        n = self.nodes[i]
        if "classes" not in n:
            n["classes"] = " ".join(n["attrs"].get("class", "").lower().split())
        return n["classes"]

    def text(self, i: int = -1, gap: str = " ") -> str:
        return gap.join(self.pieces[slice(*self.nodes[i]["said"])] if i >= 0 else self.pieces)

    def source(self, i: int) -> str:
        """What stands in a script or style."""
        return self.nodes[i]["own_text"]

    def find(self, i: int, ok: Callable[[int], bool]) -> int | None:
        """The first node inside that satisfies `ok`."""
        return next((k for k in self.below(i) if ok(k)), None)

    def _within(self, found: list[int], inside: int) -> list[int]:
        return found[bisect_left(found, inside + 1) : bisect_left(found, self.nodes[inside]["end"])] if inside >= 0 else found[:]

    def all(self, *tags: str, inside: int = -1) -> list[int]:
        if self._tags is None:
            self._tags = defaultdict(list)
            for k, n in enumerate(self.nodes):
                self._tags[n["tag"]].append(k)
        found = [self._within(self._tags[t], inside) for t in set(tags) if t in self._tags]
        return found[0] if len(found) == 1 else sorted(k for ks in found for k in ks)

    def having(self, name: str, inside: int = -1) -> list[int]:
        """Everything inside a node that has the attribute."""
        if name not in self._attrs:
            self._attrs[name] = [k for k, n in enumerate(self.nodes) if name in n["attrs"]]
        return self._within(self._attrs[name], inside)

    def marked(self, i: int, words) -> bool:
        """Whether the classes of a node hold any of the words."""
        if c := self.classes(i):
            for w in words:
                if w in c:
                    return True
        return False

    def said(self) -> Iterator[tuple[int, str]]:
        """(element, its own text) of every element that has visible text."""
        for n in self.nodes:
            if n["own_text"] and n["tag"] not in ("script", "style"):
                yield n["id"], n["own_text"]


def kept(rule: Callable) -> Callable:
    """A rule of a page and a node, worked out once for each node."""

    @wraps(rule)
    def found(page: Page, i: int):
        key = rule, i
        if key not in page.kept:
            page.kept[key] = rule(page, i)
        return page.kept[key]

    return found


# What needs no general rules: a base with a plain host, and a path from its root without empty parts or dots as parts.
_PLAIN_BASE, _PLAIN_PATH = re.compile(r"https?://([A-Za-z0-9.:-]+)(?=[/?#]|\Z)"), re.compile(r"(?:/(?![./])[A-Za-z0-9_.~%+-]*+)++(?:\?[A-Za-z0-9_.~%+=&-]++)?+\Z")


# A query alone goes behind a plain path.
_PLAIN_PAGE, _PLAIN_QUERY = re.compile(r"(https?://[A-Za-z0-9.:-]+(?:/[A-Za-z0-9_.~%+/-]*+)?)(?=[?#]|\Z)"), re.compile(r"\?[A-Za-z0-9_.~%+=&-]++\Z")


def resolve(base: str, href: str) -> str:
    """A link against its page's URL; '' for none and for what is no URL."""
    if href and href[0] == "?" and _PLAIN_QUERY.match(href) and (plain := _PLAIN_PAGE.match(base or "")):
        return plain[1] + href
    if href and _PLAIN_PATH.match(href) and (plain := _PLAIN_BASE.match(base or "")):
        return plain[0] + href
    try:
        return urljoin(base or "", href.strip()) if href and href.strip() else ""
    except ValueError:
        return ""


def host(u: str) -> str:
    if plain := _PLAIN_BASE.match(u or ""):
        return plain[1]
    try:
        return urlparse(u or "").netloc
    except ValueError:
        return ""


def leads(href: str) -> bool:
    """Whether a link leads to a page."""
    return bool(href) and not href.lower().startswith(("javascript:", "mailto:", "tel:", "#"))


def _chars(x) -> int:
    return len(x) if isinstance(x, str) else sum(map(_chars, x)) if isinstance(x, (list, tuple)) else 1


def per_page(pages: DataFrame, schema: str, rows_of: Callable[[Page, str], Iterator[tuple]], more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `schema`, page_id first, that a function of a page, its URL and the columns `more` gives; one page in memory at a time."""
    kinds: StructType = _parse_datatype_string(f"page_id long, {schema}")
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], arrow.names)
        rows, held = [], 0
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "html", *more)]
            for k in range(b.num_rows):
                page_id, url, html, *rest = (c[k].as_py() for c in columns)
                for row in rows_of(Page(html), url or "", *rest):
                    rows.append((page_id, *row))
                    held += sum(map(_chars, row))
                    if len(rows) == BATCH_ROWS or held > BATCH_CHARS:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    return pages.select("page_id", "url", "html", *more).mapInArrow(run, kinds)
