"""Elements of HTML pages by their nesting, for what a pattern cannot tell: containers in containers, and unclosed tags."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabularium.sources.markup import tokens

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walk:
    """All links of a page as ``[href, pieces of label]``, and for each element that ``wanted`` names those inside it."""

    def __init__(self, page: str, wanted: Callable[[str, dict], str | None] = lambda tag, have: None):
        self.links: list[list] = []
        self.found: list[tuple[str, list]] = []
        open_: list[tuple[str, list | None, list | None]] = []
        live, boxes, depth = [], [], Counter()  # what of the open elements is a link or wanted, and how many are of each tag
        for kind, told, have in tokens(page):
            if kind == "text":
                piece = told.strip()
                for link in live if piece else ():
                    link[1].append(piece)
            elif kind == "end":
                while depth[told]:
                    tag, box, link = open_.pop()
                    depth[tag] -= 1
                    if box is not None:
                        boxes.pop()
                    if link is not None:
                        live.pop()
                    if tag == told:
                        break
            else:
                name, links = wanted(told, have), None
                if name is not None:
                    links = []
                    self.found.append((name, links))
                if told in _VOID:
                    continue
                link = [have["href"], []] if told == "a" and "href" in have else None
                if links is not None:
                    boxes.append(links)
                if link is not None:
                    self.links.append(link)
                    live.append(link)
                    for box in boxes:
                        box.append(link)
                open_.append((told, links, link))
                depth[told] += 1


def _rows(pages: DataFrame, walk: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    names = [c for c in pages.columns if c != "html"]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names) + ", ord int, " + fields
    added = [f.split()[0] for f in fields.split(", ")]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, html in enumerate(b.column("html").to_pylist()):
                for k, row in enumerate(walk(html or "")):
                    at.append(i)
                    rows.append((k, *row))
            cols = list(zip(*rows)) if rows else [[]] * (1 + len(added))
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], names=[*names, "ord", *added])

    return pages.select(*names, "html").mapInArrow(walked, schema)


def anchors(pages: DataFrame) -> DataFrame:
    """``ord, href, label`` of every link of each page, beside the page's columns.

    Null and empty pages have none; a link that is not closed ends with what is around it; a label's pieces are stripped and
    joined, and may be empty. Comments, scripts and attributes of other names hold no links.
    """
    return _rows(pages, lambda html: [(href, "".join(pieces)) for href, pieces in _Walk(html).links], "href string, label string")


def links_inside(pages: DataFrame, tag: str, css_class: str) -> DataFrame:
    """``ord, href, label`` of every link in an element of a class, once for each such element around it.

    Null pages have none; the columns of ``pages`` besides ``html`` stay. A label's pieces are stripped and joined.
    """

    def walk(html: str) -> list[tuple]:
        w = _Walk(html, lambda t, have: "" if t == tag and css_class in have.get("class", "").split() else None)
        return [(href, "".join(pieces)) for _, links in w.found for href, pieces in links]

    return _rows(pages, walk, "href string, label string")


def first_links(pages: DataFrame, attribute: str) -> DataFrame:
    """``ord, name, href`` of the first link inside every element that has an attribute; elements without a link give none."""

    def walk(html: str) -> list[tuple]:
        w = _Walk(html, lambda _, have: have.get(attribute))
        return [(name, links[0][0]) for name, links in w.found if links]

    return _rows(pages, walk, "name string, href string")


def hidden_value(html: str, name: str) -> str | None:
    """The value of the first input of a name that has one."""
    return next((have["value"] for kind, tag, have in tokens(html) if kind == "start" and tag == "input" and have.get("name") == name and have.get("value")), None)
