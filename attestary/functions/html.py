"""Visible text and outbound links of HTML by the standard parser, in an Arrow-fed helper.

The rule: what stands in boilerplate elements is dropped; each text node is a line; blanks collapse and empty lines go.
Links are absolute, without fragment, distinct and in order of appearance. Parts of a page are named by selectors of tags,
#ids and .classes, with blanks for what lies within and commas for what may be either."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content of their own, and schemes that are no links to pages (fixed values).
BOILERPLATE = frozenset(("script", "style", "noscript", "nav", "footer", "header", "svg", "form"))
NO_PAGE = ("mailto:", "javascript:", "#", "tel:")
#: Elements without an end, those that end where the like of them begins, and headings (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class _Text(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden, self.lines, self.links, self.in_title, self.title, self.in_head = base, [], [], {}, False, [], False

    def handle_starttag(self, tag, attrs):
        if tag in BOILERPLATE:
            self.hidden.append(tag)
        self.in_title, self.in_head = tag == "title", self.in_head and tag != "body" or tag == "head"
        if tag == "a" and not self.hidden and (url := _absolute(self.base, dict(attrs).get("href"))):
            self.links[url] = None

    def handle_startendtag(self, tag, attrs):
        if tag not in BOILERPLATE:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.hidden:  # closes what was left open inside, too
            while self.hidden.pop() != tag:
                pass
        self.in_title, self.in_head = False, self.in_head and tag != "head"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden and not self.in_head:
            self.lines += [x for x in (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in data.splitlines()) if x]


def extract(html: str | None, base: str | None = "") -> dict:
    parser = _Text(base or "")
    parser.feed(html or "")
    parser.close()
    return {"title": " ".join("".join(parser.title).split()), "text": "\n".join(parser.lines), "links": list(parser.links)}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)  # nodes and strings

    def all(self, above: tuple = ()) -> Iterator[tuple[Node, tuple]]:
        """This node and those in it, in document order, each with the nodes above it."""
        todo = [(self, above)]
        while todo:
            node, over = todo.pop()
            yield node, over
            todo += [(k, (*over, node)) for k in reversed(node.kids) if isinstance(k, Node)]

    def text(self) -> str:
        """All its text, blanks collapsed."""
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                todo += reversed(x.kids)
        return " ".join(" ".join(parts).split())

    def visible(self, base: str) -> tuple[list[str], list[str]]:
        """(lines, links) by the rule above."""
        lines, links, todo = [], {}, [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                lines += [y for y in (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in x.splitlines()) if y]
            elif x.tag not in BOILERPLATE and x.tag != "head":
                if x.tag == "a" and (url := _absolute(base, x.attrs.get("href"))):
                    links[url] = None
                todo += reversed(x.kids)
        return lines, list(links)


def _absolute(base: str, href: str | None) -> str | None:
    href = (href or "").strip()
    if not href or href.startswith(NO_PAGE):
        return None
    try:
        return urldefrag(urljoin(base, href)).url
    except ValueError:  # an address that can't be read is no link
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while self.open[-1].tag in ENDS.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


@lru_cache(maxsize=256)
def _marks(simple: str) -> tuple[str, list[str]]:
    tag, *marks = re.split(r"(?=[.#])", simple)
    return tag, marks


def _is(node: Node, simple: str) -> bool:
    tag, marks = _marks(simple)
    if not marks:
        return tag in ("", "*", node.tag)
    classes = node.attrs.get("class", "").split()
    return tag in ("", "*", node.tag) and all(m[1:] in classes if m[0] == "." else m[1:] == node.attrs.get("id") for m in marks)


def select(root: Node, selector: str) -> Iterator[Node]:
    """The nodes that a selector names, in document order."""
    ways = [way.split() for way in selector.split(",")]
    for node, above in root.all():
        for *over, last in ways:
            if node.tag and _is(node, last):
                rest = list(over)
                for a in reversed(above):
                    if rest and _is(a, rest[-1]):
                        rest.pop()
                if not rest:
                    yield node
                    break


def _first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)


def sections(html: str | None, base: str | None, selector: str, title: str) -> list[dict]:
    out = []
    for node in select(tree(html), selector):
        head, (lines, links) = _first(node, title), node.visible(base or "")
        out.append({"id": node.attrs.get("id") or None, "title": head.text() if head else "", "text": "\n".join(lines), "links": links})
    return out


def outline(html: str | None, base: str | None, selector: str) -> list[dict]:
    """The headings of a page and the links that the selector names, each with its place in the document."""
    root = tree(html)
    place = {id(node): n for n, (node, _) in enumerate(root.all())}
    heads = [{"pos": place[id(n)], "kind": "heading", "href": None, "text": n.text()} for n in select(root, ",".join(sorted(HEADINGS)))]
    links = [n for n in select(root, selector) if n.tag == "a" and n.attrs.get("href")]
    return heads + [{"pos": place[id(n)], "kind": "link", "href": urldefrag(urljoin(base or "", n.attrs["href"])).url, "text": n.text()} for n in links]


def region(html: str | None, base: str | None, selector: str | None) -> dict:
    """Title and, of the first part that the selector names or of all, text and links; found: there is such a part."""
    root = tree(html)
    title, part = _first(root, "title"), _first(root, selector) if selector else root
    lines, links = part.visible(base or "") if part else ([], [])
    return {"title": title.text() if title else "", "text": "\n".join(lines), "links": links, "found": part is not None}


def _row(data_rank: str | None, titles: list[str], cells: list[dict]) -> dict:
    return {"data_rank": data_rank, "titles": titles, "cells": cells}


def _parsed_rows(html: str | None) -> list[dict]:
    table = _first(tree(html), "table")
    out = []
    for tr in select(table, "tr") if table else ():
        cells = []
        for cell in (k for k in tr.kids if isinstance(k, Node) and k.tag in ("td", "th")):
            bold = _first(cell, ".fw-bold")
            titles = [n.attrs["title"] for n, _ in cell.all() if "title" in n.attrs]
            cells.append({"text": cell.text(), "classes": cell.attrs.get("class", "").split(), "titles": titles, "bold": bold.text() if bold else None})
        titles = [n.attrs["title"] for n, _ in tr.all() if "title" in n.attrs]
        out.append(_row(tr.attrs.get("data-rank"), titles, cells))
    return out


#: What stands within a tag in plain spelling, and one of its attributes.
_TAG = re.compile(r'(/?[a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&\r]*")*)')
_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')
#: Elements whose content is no markup, parts of a table around its rows, and elements that a cell may hold and that have no rules of their own (fixed values).
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
_AROUND = frozenset(("thead", "tbody", "tfoot"))
_INLINE = frozenset("a abbr b big code del div em font i ins mark s small span strong sub sup time tt u".split())


@lru_cache(maxsize=4096)
def _plain_tag(within: str) -> tuple[str | None, dict[str, str] | None]:
    """A tag's name and attributes; no name, if it is not in plain spelling."""
    m = _TAG.fullmatch(within)
    return (m[1], dict(_ATTR.findall(m[2])) if m[2] else None) if m else (None, None)


def _scanned_cell(tag: str, attrs: dict[str, str] | None, text: str, tags: Iterator[tuple]) -> dict | None:
    """A cell, to whose end the tags are read."""
    classes = attrs.get("class", "").split() if attrs else []
    titles = [attrs["title"]] if attrs and "title" in attrs else []
    open_, parts, bold, bold_at, first = ["/" + tag], [unescape(text) if "&" in text else text], None, 0 if "fw-bold" in classes else -1, 0
    for tag, attrs, text in tags:
        if tag == open_[-1]:
            open_.pop()
            if len(open_) == bold_at and bold is None:
                bold = " ".join(" ".join(parts[first:]).split())
            if not open_:
                return {"text": " ".join(" ".join(parts).split()), "classes": classes, "titles": titles, "bold": bold}
        elif tag in _INLINE:
            if attrs:
                if "title" in attrs:
                    titles.append(attrs["title"])
                if bold_at < 0 and "fw-bold" in attrs.get("class", "").split():
                    bold_at, first = len(open_), len(parts)
            open_.append("/" + tag)
        else:
            return None
        if text:
            parts.append(unescape(text) if "&" in text else text)
    return None


def _scanned_rows(html: str) -> list[dict] | None:
    """The rows of a table whose tags are all in plain spelling, closed and nested as tables are; None for any other page, which takes a parser.
    Each tag is looked at once and no tree is built."""
    found, in_table = [], False
    for piece in html.split("<")[1:]:
        within, ends, text = piece.partition(">")
        tag, attrs = _plain_tag(within)
        if tag is None or not ends or not in_table and tag in _RAW:
            return None
        in_table = in_table or tag == "table"
        if in_table:
            found.append((tag, attrs, text))
    out, around, row, tags = [], [], None, iter(found[1:])
    for tag, attrs, text in tags:
        if row is not None:
            if tag == "td" or tag == "th":
                cell = _scanned_cell(tag, attrs, text, tags)
                if cell is None:
                    return None
                row["cells"].append(cell)
                row["titles"].extend(cell["titles"])
            elif tag == "/tr":
                row = None
            else:
                return None
        elif tag == "tr":
            attrs = attrs or {}
            row = _row(attrs.get("data-rank"), [attrs["title"]] if "title" in attrs else [], [])
            out.append(row)
        elif tag in _AROUND:
            around.append("/" + tag)
        elif around and tag == around[-1]:
            around.pop()
        else:
            return out if tag == "/table" and not around else None
    return None


def table_rows(html: str | None) -> list[dict]:
    """The rows of the first table: their data-rank, all title attributes within, and their cells."""
    rows = _scanned_rows(html) if html else None
    return _parsed_rows(html) if rows is None else rows


def embedded(html: str | None, selector: str) -> str | None:
    node = _first(tree(html), selector)
    return None if node is None else "".join(k for k in node.kids if isinstance(k, str))


def feed_link(html: str | None) -> str | None:
    """The first RSS or Atom address that a page names as its alternate."""
    for node in select(tree(html), "link"):
        kind, rel = node.attrs.get("type", "").strip().lower(), node.attrs.get("rel", "").lower().split()
        if "alternate" in rel and kind in ("application/rss+xml", "application/atom+xml") and node.attrs.get("href"):
            return node.attrs["href"].strip()
    return None


def plain_list_column(texts: Column, base: Column) -> Column:
    """plain_column of each text of an array."""
    one = lambda ts, b: None if ts is None else [t if t is None or "<" not in t else extract(t, b)["text"] for t in ts]
    return _by_page("array<string>", _TEXTS, one, texts, base)




_STRUCT = "title:string,text:string,links:array<string>"
_PART = "title string, text string, links array<string>"


#: Characters and rows that a helper works on at once: what it makes of a page is many times the page's size, so it is handed on
#: before the next pages are read, and a task's memory doesn't follow the number of rows in a batch.
_CHARS_AT_ONCE, _ROWS_AT_ONCE = 1 << 19, 1024


def _few(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The rows in lists of few characters; the first value of a row is its text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0]) if row[0] is not None else 0
        if size >= _CHARS_AT_ONCE or len(held) >= _ROWS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())


def _struct(**fields: pa.DataType) -> pa.DataType:
    return pa.struct(list(fields.items()))


def in_few(one, made: pa.DataType, batches: Iterator) -> Iterator[pa.Array]:
    """one(...) of each row's values. Of a batch only few rows at a time are made strings of Python, the others stay in Arrow's memory."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for few in _few(zip(*((x.as_py() for x in column) for column in columns))):
            # some pages at a time, whose rows are gone again before Python looks for garbage among them
            yield pa.concat_arrays([pa.array([one(*x) for x in few[k : k + 4]], made) for k in range(0, len(few), 4)])


def _by_page(schema: str, made: pa.DataType, one, *columns: Column) -> Column:
    """one(...) of each row's values, in an Arrow-fed helper; made: the schema as Arrow has it."""
    run = F.arrow_udf(lambda batches: in_few(one, made, batches), schema, F.ArrowUDFType.SCALAR_ITER)
    # else a filter on what it gives is moved before the rows are dealt out, and each page is read once for the filter and once more
    return run.asNondeterministic()(*columns)


def sections_column(html: Column, base: Column, selector: str, title: str) -> Column:
    made = pa.list_(_struct(id=_TEXT, title=_TEXT, text=_TEXT, links=_TEXTS))
    return _by_page(f"array<struct<id:string,{_STRUCT}>>", made, lambda h, b: sections(h, b, selector, title), html, base)


def outline_column(html: Column, base: Column, selector: str = "a") -> Column:
    made = pa.list_(_struct(pos=pa.int32(), kind=_TEXT, href=_TEXT, text=_TEXT))
    return _by_page("array<struct<pos:int,kind:string,href:string,text:string>>", made, lambda h, b: outline(h, b, selector), html, base)


def table_column(html: Column) -> Column:
    cell = "struct<text:string,classes:array<string>,titles:array<string>,bold:string>"
    made = pa.list_(_struct(data_rank=_TEXT, titles=_TEXTS, cells=pa.list_(_struct(text=_TEXT, classes=_TEXTS, titles=_TEXTS, bold=_TEXT))))
    return _by_page(f"array<struct<data_rank:string,titles:array<string>,cells:array<{cell}>>>", made, table_rows, html)


def embedded_column(html: Column, selector: str) -> Column:
    return _by_page("string", _TEXT, lambda h: embedded(h, selector), html)


def feed_link_column(html: Column) -> Column:
    return _by_page("string", _TEXT, feed_link, html)


def unescaped_column(text: Column) -> Column:
    """Entities of markup in markup, named and numbered."""
    return _by_page("string", _TEXT, lambda t: None if t is None else unescape(t), text)


def plain_column(text: Column, base: Column) -> Column:
    """Text as it is, or what is visible of it if it has tags."""
    return _by_page("string", _TEXT, lambda t, b: t if t is None or "<" not in t else extract(t, b)["text"], text, base)


def region_column(html: Column, base: Column, selector: str | None = None) -> Column:
    """struct<title, text, links, found>"""
    made = _struct(title=_TEXT, text=_TEXT, links=_TEXTS, found=pa.bool_())
    return _by_page(f"{_PART}, found boolean", made, lambda h, b: region(h, b, selector), html, base)


def extract_column(html: Column, base: Column) -> Column:
    """struct<title, text, links>"""
    return _by_page(_PART, _struct(title=_TEXT, text=_TEXT, links=_TEXTS), extract, html, base)
