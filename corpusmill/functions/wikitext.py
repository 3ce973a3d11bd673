"""Wikitext to plain text, links, templates and external links.

A page is cut into tokens (marks, tags, line beginnings) and a machine with a stack of open elements reads them once. An element
that closes hands its text to the one around it, or none of it; so elements nest in each other as they come. What nothing closes is
text again, with its mark.

* `{{name|...}}` leaves no text; its name is a template, nested ones included. `{{{name|default}}}` leaves its default.
* `{| ... |}` at line beginnings leaves no text; links and templates inside count.
* `[[title|shown]]` leaves what it shows, or its title without a leading colon. Files, images and categories leave nothing; links in a
  file's caption count.
* `[url shown]` leaves what it shows; bare addresses stay. Both are external links, also inside refs, templates and tables.
* `<ref>`, `<gallery>`, `<math>`, `<syntaxhighlight>`, `<timeline>`, `<score>` leave no text; a ref's links and templates count,
  the others' contents are no wikitext. `<nowiki>` and `<pre>` leave their content as it is. Other tags go, their content stays.
* Comments leave nothing. Bold and italic marks, behaviour switches, headings' marks, list marks and rules at line beginnings go; entities
  are resolved at the end. Unmarked text of `<nowiki>` and `<pre>` is set aside until then.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags whose content is no text, and those whose content is no wikitext.
HIDDEN = ("ref", "gallery", "math", "chem", "syntaxhighlight", "source", "timeline", "score", "graph", "mapframe", "templatedata")
RAW = ("nowiki", "pre", "gallery", "math", "chem", "syntaxhighlight", "source", "timeline", "score", "graph", "mapframe", "templatedata")

_TOKEN = re.compile(
    r"""(?P<comment><!--.*?(?:-->|\Z))
    |(?P<raw><(?P<rawname>""" + "|".join(RAW) + r""")\b[^<>]*?(?:/>|>(?P<content>.*?)</(?P=rawname)\s*>))
    |(?P<tag><(?P<end>/?)(?P<name>[a-z][a-z0-9]*)\b[^<>]*?(?P<alone>/?)>)
    |(?P<open>\{\{\{(?!\{)|\{\{|\[\[|^[ \t:]*\{\||\[(?=(?:https?:|ftp:)?//|mailto:))
    |(?P<close>\}\}\}|\}\}|\]\]|\]|^[ \t]*\|\}(?!\}))
    |(?P<url>(?<![\w/])(?:https?|ftp)://[^\s\[\]<>{}|"]+)
    |(?P<pipe>\|)
    |(?P<gone>'{2,5}|__[A-Z]{3,}__)""",
    re.M | re.S | re.X | re.I,
)
#: Where a token may begin, or just before: marks, bold or italic, a switch, the colon of an address, the end of a line that blanks and a table's mark follow.
_PLACE = re.compile(r"[<{\[|}\]'_:\n](?:(?<=[<{\[|}\]])|(?<=')(?=')|(?<=_)(?=_)|(?<=:)(?=//)|(?<=\n)(?=[ \t:]+(?:\{\||\|\})))")
_MEDIA = re.compile(r"\s*(?:file|image|media)\s*:", re.I)
#: Characters without which a page has no such lines, the lines' marks, and what stays.
_LINES = ((re.compile("="), re.compile(r"^(={1,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", re.M), r"\2"), (re.compile("[*#:;-]"), re.compile(r"^(?:[*#:;]+[ \t]*|-{4,})", re.M), ""))
_ASIDE = re.compile("\x00(\\d+)\x00")
#: What an end may close over: open elements of these kinds are text then.
_OVER = {
    "template": {"link", "external", "parameter", "table", "ref"}, "parameter": {"link", "external", "table", "ref"}, "link": {"external"}, "external": set(),
    "table": {"link", "external", "ref"}, "ref": {"link", "external", "template", "parameter", "table"},
}
_KINDS = {"{{{": "parameter", "{{": "template", "[[": "link", "[": "external", "}}}": "parameter", "}}": "template", "]]": "link", "]": "external"}

RESULT = pa.struct([("plain_text", pa.string()), ("links", pa.list_(pa.string())), ("templates", pa.list_(pa.string())), ("external_links", pa.list_(pa.string()))])


class _Machine:
    """The stack of open elements (kind, mark, parts between pipes), and what closed ones have given."""

    def __init__(self, category_prefix: str):
        self.category_prefix = category_prefix
        self.stack: list[tuple[str, str, list[list[str]]]] = [("page", "", [[]])]
        self.links: list[str] = []
        self.templates: list[str] = []
        self.external: list[str] = []
        self.aside: list[str] = []

    def put(self, text: str) -> None:
        if text:
            self.stack[-1][2][-1].append(text)

    def open(self, kind: str, mark: str) -> None:
        self.stack.append((kind, mark, [[]]))

    def finds(self, kind: str) -> int | None:
        """The place of the open element that an end of this kind closes."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == kind:
                return i
            if self.stack[i][0] not in _OVER[kind]:
                return None
        return None

    def close(self, kind: str, mark: str) -> None:
        at = self.finds(kind)
        if at is None:
            self.put(mark if kind not in ("table", "ref") else "")
            return
        self.spill(at + 1)
        parts = ["".join(p) for p in self.stack.pop()[2]]
        self.put(self.left(kind, parts))

    def spill(self, at: int) -> None:
        """What is open from there on is no element: its mark and text go to the one around it."""
        while len(self.stack) > at:
            _, mark, parts = self.stack.pop()
            self.put(mark + "|".join("".join(p) for p in parts))

    def left(self, kind: str, parts: list[str]) -> str:
        """The text that a closed element leaves."""
        if kind == "template":
            self.templates.append(parts[0].strip())
        elif kind == "parameter":
            return "|".join(parts[1:])
        elif kind == "link":
            title = parts[0].strip()
            if not title or "\n" in title:
                return f"[[{'|'.join(parts)}]]"
            self.links.append(title)
            if not _MEDIA.match(title) and not title.startswith(self.category_prefix):
                return (parts[-1] if len(parts) > 1 else "") or title.lstrip(":")
        elif kind == "external":
            address, _, shown = "|".join(parts).partition(" ")
            self.external.append(address)
            return shown
        return ""


def _next_token(text: str, at: int) -> re.Match | None:
    """What _TOKEN.search(text, at) finds; tokens are tried only where one may begin, since most of a page has none. No token ends with a line."""
    if not at and (m := _TOKEN.match(text)):
        return m
    place = at
    while found := _PLACE.search(text, place):
        place = found.end()
        mark = found.group()
        starts = range(max(at, place - 6), place - 3) if mark == ":" else (place,) if mark == "\n" else (place - 1,)
        for start in starts:
            if m := _TOKEN.match(text, start):
                return m
    return None


def parse_wikitext(text: str, category_prefix: str = "Category:") -> dict:
    """plain_text, link titles, template names and external links of a page."""
    page, at = _Machine(category_prefix), 0
    text = text.replace("\x00", "")
    while m := _next_token(text, at):
        page.put(text[at : m.start()])
        at, mark = m.end(), m.group()
        if m["raw"]:
            if m["rawname"].lower() not in HIDDEN and m["content"]:
                page.put(f"\x00{len(page.aside)}\x00")
                page.aside.append(m["content"])
        elif m["tag"]:
            if m["name"].lower() == "ref" and not m["alone"]:
                page.close("ref", "") if m["end"] else page.open("ref", "")
        elif m["open"]:
            page.open(_KINDS.get(mark, "table"), mark)
        elif m["close"]:
            kind = _KINDS.get(mark, "table")
            if kind == "parameter" and page.finds(kind) is None:  # a template's end and a brace
                at, kind, mark = m.start() + 2, "template", "}}"
            elif kind == "link" and page.finds(kind) is None:  # an external link's end, perhaps, and a bracket
                at, kind, mark = m.start() + 1, "external", "]"
            page.close(kind, mark)
        elif m["url"]:
            kind, _, parts = page.stack[-1]
            if kind != "external" or parts != [[]]:
                page.external.append(mark.rstrip(".,;:!?)'"))
            page.put(mark)
        elif m["pipe"]:
            page.stack[-1][2].append([]) if page.stack[-1][0] in ("template", "link", "parameter") else page.put(mark)
    page.put(text[at:])
    page.spill(1)
    plain = "".join(page.stack[0][2][0])
    for begins, marks, stays in _LINES:
        if begins.search(plain):
            plain = marks.sub(stays, plain)
    plain = _ASIDE.sub(lambda m: page.aside[int(m[1])], html.unescape(plain))
    return {"plain_text": plain, "links": page.links, "templates": page.templates, "external_links": page.external}


def wikitext_column(text: Column, category_prefix: str = "Category:") -> Column:
    @F.arrow_udf("struct<plain_text:string,links:array<string>,templates:array<string>,external_links:array<string>>")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if v is None else parse_wikitext(v, category_prefix) for v in b.to_pylist()], RESULT)

    return convert(text)
