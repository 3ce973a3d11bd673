"""HTML to text, links and main articles, with the standard library's parser in Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
#: Pages that are Python objects at once.
_PAGES = 32


class _Node:
    """An element. It does not know the one around it, so that a page's tree is freed with the page and waits for no collection of cycles."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def texts(self) -> Iterator[str]:
        """Text nodes outside scripts and styles."""
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in _HIDDEN:
                yield from child.texts()

    def walk(self) -> Iterator[_Node]:
        for child in self.children:
            if isinstance(child, _Node):
                yield child
                yield from child.walk()


class _Tree(HTMLParser):
    """A forgiving tree: end tags close up to the nearest element of their name and are dropped without one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


class _Texts(HTMLParser):
    """The text nodes of the same tree outside scripts and styles, without the tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)
            self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] == tag:
                self.hidden -= sum(t in _HIDDEN for t in self.open[at:])
                del self.open[at:]
                return

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def parse(page: str) -> _Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def html_to_text(page: str) -> str:
    """Text nodes joined by a space."""
    texts = _Texts()
    texts.feed(page)
    texts.close()
    return " ".join(texts.found)


def main_article(page: str, section_id: str, stop: str) -> str | None:
    """Text of the section with this id: without what comes up to its last blockquote, and from the text node that begins with `stop` on.

    None without such a section. Text nodes are stripped and joined by newlines; runs of newlines become one.
    """
    section = next((n for n in parse(page).walk() if n.attrs.get("id") == section_id), None)
    if section is None:
        return None
    quote = next((n for n in section.walk() if n.tag == "blockquote"), None)
    if quote is not None:
        siblings = next(n.children for n in (section, *section.walk()) if any(c is quote for c in n.children))
        del siblings[: next(i for i, c in enumerate(siblings) if c is quote) + 1]
    kept = []
    for text in section.texts():
        if stop and text.strip().startswith(stop):
            break
        if text.strip():
            kept.append(text.strip())
    return re.sub(r"\n+", "\n", "\n".join(kept))


def page_links(page: str, within_class: str | None = None) -> list[dict[str, str]]:
    """name and url of the anchors with an address, inside elements of a class if one is given."""
    root = parse(page)
    places = [root] if within_class is None else [n for n in root.walk() if n.tag == "div" and within_class in n.attrs.get("class", "").split()]
    return [{"name": " ".join(n.texts()).strip(), "url": n.attrs["href"]} for place in places for n in place.walk() if n.tag == "a" and "href" in n.attrs]


def _map(values: pa.Array, fn, kind: pa.DataType) -> pa.Array:
    """fn of each value; what Python holds at once are the objects of a few values, not those of the batch."""
    parts = [pa.array([None if v is None else fn(v) for v in values.slice(i, _PAGES).to_pylist()], kind) for i in range(0, len(values), _PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def bound_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 500) -> None:
    """Let Spark send batches of at most about `size` bytes and `rows` rows to Python, so that a worker's memory does not grow with a partition's pages; a session with lower bounds keeps them."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)))
        if not 0 < now <= most:  # 0: no bound
            spark.conf.set(key, str(most))


def html_text_column(page: Column) -> Column:
    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _map(b, html_to_text, pa.string())

    return convert(page)


def main_article_column(page: Column, section_id: str, stop: str = "Tilvísun:") -> Column:
    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _map(b, lambda v: main_article(v, section_id, stop), pa.string())

    return convert(page)


def links_column(page: Column, within_class: str | None = None) -> Column:
    kind = pa.list_(pa.struct([("name", pa.string()), ("url", pa.string())]))

    @F.arrow_udf("array<struct<name:string,url:string>>")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _map(b, lambda v: page_links(v, within_class), kind)

    return convert(page)
