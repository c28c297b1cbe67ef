"""Web pages read as trees: one pass of a tokenizer with a stack of open elements, over Arrow batches.

The pass takes time linear in a page's length, whatever its markup: every search that finds nothing is remembered, so that no
stretch is looked through twice, and an end tag pops what it closes once. Elements stay open until an end tag of their
name, or of one around them, closes them; an end tag without an open element of its name does nothing. script and style hold
plain text, title and textarea text with entities. Entities are those of HTML, names without a semicolon included unless
a caller sets `bare` to False.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Elements of a page that are not its text, the elements that hold it, best first, and those without content.
CHROME = frozenset(("script", "style", "noscript", "svg", "nav", "footer", "header", "form"))
HOLDERS = ("main", "article", "body")
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
# Elements whose content is no markup, and those whose text is not read.
RAW, ESCAPED = ("script", "style"), ("title", "textarea")
UNREAD = CHROME | {"template", "rt", "rp"}
# The meta tags in which pages say when they were published, best first, and the fields of their linked data.
DATE_META = (("property", "article:published_time"), ("property", "article:modified_time"), ("name", "date"), ("name", "pubdate"), ("itemprop", "datePublished"), ("itemprop", "dateModified"))
DATE_FIELDS = ("datePublished", "dateModified")

_OPENS = re.compile(r"<(?=[a-zA-Z!?/])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLOSED = re.compile(r"&(#(?:[0-9]+|[xX][0-9a-fA-F]+);|[a-zA-Z][a-zA-Z0-9]*;)")


class _Reader:
    """The tokens of one page: text, ("<", name, attributes as they stand, closed at once) and (">", name)."""

    def __init__(self, page: str):
        self.page, self.missing = page, {}

    def find(self, what: str, start: int) -> int:
        """Where `what` stands next, -1 if nowhere; the latter is found out once."""
        if start >= self.missing.get(what, len(self.page) + 1):
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.missing[what] = start
        return at

    def tag_end(self, start: int) -> int:
        """The > that ends a tag, quoted ones passed over; a quote that is never closed quotes nothing."""
        at = start
        while stop := _TAG_STOP.search(self.page, at):
            if stop[0] == ">":
                return stop.start()
            before = stop.start() - 1
            while before >= at and self.page[before] in " \t\n\r\f":
                before -= 1
            close = self.find(stop[0], stop.end()) if before >= at and self.page[before] == "=" else -1  # others are part of a name
            at = close + 1 if close >= 0 else stop.end()
        return -1

    def tokens(self) -> Iterator[tuple]:
        page, at = self.page, 0
        while at < len(page):
            tag = _OPENS.search(page, at)
            if tag is None:
                yield ("", page[at:])
                return
            if tag.start() > at:
                yield ("", page[at : tag.start()])
            at, first = tag.start(), page[tag.end()]
            if first in "!?" or page[at + 1 : at + 3] == "/>" or (first == "/" and not _NAME.match(page, at + 2)):
                comment = page.startswith("<!--", at)
                end = self.find("-->" if comment else ">", at + (4 if comment else 1))
                yield ("!",)
                at = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            name = _NAME.match(page, tag.end() + (first == "/"))
            end = self.tag_end(name.end())
            if end < 0:  # a tag that never ends is text
                yield ("", page[at:])
                return
            called, at = name[0].lower(), end + 1
            if first == "/":
                yield (">", called)
                continue
            closed = page[end - 1] == "/"
            yield ("<", called, page[name.end() : end], closed)
            if not closed and called in RAW + ESCAPED:
                close = re.compile(rf"</{called}(?=[\s/>])", re.IGNORECASE)
                found = None if self.missing.get(close.pattern) else close.search(page, at)
                if found is None:
                    self.missing[close.pattern] = 1
                stop = found.start() if found else len(page)
                if stop > at:
                    yield ("raw" if called in RAW else "", page[at:stop])
                at = stop


def _closed(text: str) -> str:
    """text with the entities decoded that end in a semicolon."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0], text)


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        out[name.lower()] = html.unescape(next((v for v in values if v), ""))
    return out


def _stated(script: str) -> str | None:
    """The date of the first object of linked data that has one."""
    try:
        data = json.loads(script)
    except (ValueError, RecursionError):
        return None
    for o in data if isinstance(data, list) else [data]:
        for field in DATE_FIELDS if isinstance(o, dict) else ():
            if o.get(field):
                return str(o[field]).strip()
    return None


def read_page(page: str, bare: bool = True) -> tuple[str | None, str | None, str]:
    """(title, date, text) of a page; see title(), page_date() and page_text(). Unless `bare`, entities of its text end in a semicolon."""
    decoded = html.unescape if bare else _closed
    stack: list[str] = []
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    hidden: int | None = None  # the depth of the outermost element that is not read
    holders: dict[str, tuple[int, list[str]]] = {}  # of each kind the first: its depth, -1 once it is closed, and its strings
    metas: dict[tuple[str, str], str] = {}
    title, linked, data, script = None, None, [], []

    def flush() -> None:
        text = decoded("".join(data)).strip()
        data.clear()
        if text and hidden is None:
            for depth, strings in holders.values():
                if depth >= 0:
                    strings.append(text)

    def pop_to(depth: int) -> None:
        nonlocal hidden
        for name in stack[depth:]:
            depths[name].pop()
        del stack[depth:]
        if hidden is not None and hidden >= depth:
            hidden = None
        for kind, (at, strings) in holders.items():
            if at >= depth:
                holders[kind] = (-1, strings)

    for token in _Reader(page).tokens():
        if token[0] in ("", "raw"):
            if token[0] == "raw" or (stack and stack[-1] in RAW):
                script.append(token[1])
            else:
                data.append(token[1])
                if title is None and stack and stack[-1] == "title":
                    title = decoded(token[1])
            continue
        flush()
        if token[0] == "<":
            _, name, rest, closed = token
            if name == "meta":
                have = _attributes(rest)
                for key in DATE_META:
                    if key not in metas and have.get(key[0]) == key[1]:
                        metas[key] = have.get("content", "")
            if name == "title" and title is None and closed:
                title = ""
            if name == "script":
                script.clear()
                wanted = _attributes(rest).get("type") == "application/ld+json"
            if closed or name in VOID:
                if name in HOLDERS and name not in holders and hidden is None:
                    holders[name] = (-1, [])
                continue
            if hidden is None and name in UNREAD:
                hidden = len(stack)
            if name in HOLDERS and name not in holders and hidden is None:
                holders[name] = (len(stack), [])
            depths[name].append(len(stack))
            stack.append(name)
        elif token[0] == ">" and depths.get(token[1]):
            name = token[1]
            if name == "script" and linked is None and wanted:
                linked = _stated("".join(script))
            if name == "title" and title is None:
                title = ""
            pop_to(depths[name][-1])
    flush()
    date = next((metas[k].strip() for k in DATE_META if metas.get(k)), None) or linked
    strings = next((holders[k][1] for k in HOLDERS if k in holders), [])
    lines = (re.sub(r"\s+", " ", line).strip() for line in "\n".join(strings).splitlines())
    title = re.sub(r"\s+", " ", title).strip() if title else None
    return title or None, date or None, "\n".join(line for line in lines if line)


def _reader(bare: bool) -> Callable[[Column], Column]:
    @F.pandas_udf(StructType([StructField(c, StringType()) for c in ("title", "date", "text")]))
    def pages(pages: pd.Series) -> pd.DataFrame:
        none = (None, None, None)
        return pd.DataFrame([none if p is None else read_page(p, bare) for p in pages], columns=["title", "date", "text"], dtype=object)

    return pages


_READERS = {bare: _reader(bare) for bare in (True, False)}


def page(markup: Column, bare: bool = True) -> Column:
    """(title, date, text) of a page, in one pass; null of null."""
    return _READERS[bare](markup)


def title(markup: Column, bare: bool = True) -> Column:
    """The text of the first title, blanks collapsed; null where there is none."""
    return page(markup, bare)["title"]


def page_date(markup: Column) -> Column:
    """A page's own date as it spells it: meta tags in order, then the linked data in its scripts; null, never made up."""
    return page(markup)["date"]


def page_text(markup: Column, bare: bool = True) -> Column:
    """The text of the first main, else the first article, else the first body, a line for each string between tags.

    Elements of CHROME and all within them are no text, nor is a main, article or body that stands in one; an empty main is
    taken all the same. Blanks are collapsed, empty lines left out; a page with none of the three has no text.
    """
    return page(markup, bare)["text"]
