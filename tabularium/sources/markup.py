"""One pass over the text of an HTML page: tags with their attributes, text, and nothing of comments, scripts and styles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")
#: Elements whose text holds no tags: of the first two it is no text of the page at all.
_SILENT, _PLAIN = frozenset(("script", "style")), frozenset(("title", "textarea"))
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE) for tag in (*_SILENT, *_PLAIN)}


def attribute_text(value: str) -> str:
    """A value with its references resolved; one that lacks its semicolon and runs into a letter, digit or ``=`` is none."""

    def resolved(m: re.Match) -> str:
        told = m.group()
        if not told.startswith("&#") and not told.endswith(";") and value[m.end() : m.end() + 1] == "=":
            return told
        got = unescape(told)
        # A known name at the start of a longer one is part of a word here, as in "&copyright=".
        return told if not told.startswith("&#") and not told.endswith(";") and len(got) > 1 and got[-1].isalnum() else got

    return _REFERENCE.sub(resolved, value) if "&" in value else value


Token = tuple[str, str, dict[str, str] | None]


def tokens(page: str) -> Iterator[Token]:
    """``("start", tag, attributes)``, ``("end", tag, None)`` and ``("text", text, None)``, in order.

    Tags and attributes are in lower case; the last of several attributes of one name holds; values may be quoted either
    way or not at all. What is not closed (a comment, a script, a quoted value) reaches to the end; a tag that the page ends in
    is none; a ``<`` that opens nothing is text. Every letter is looked at a bounded number of times.
    """
    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "text", unescape(page[at:]), None
            return
        follows = page[open_ + 1 : open_ + 2]
        if follows not in ("!", "?", "/") and not (follows.isascii() and follows.isalpha()):
            yield "text", unescape(page[at : open_ + 1]), None
            at = open_ + 1
            continue
        if open_ > at:
            yield "text", unescape(page[at:open_]), None
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = n if end < 0 else end + 3
        elif follows in "!?/":
            end = page.find(">", open_)
            if follows == "/" and (name := _NAME.match(page, open_ + 2)) and end >= 0 and name.group()[0].isalpha():
                yield "end", name.group().lower(), None
            at = n if end < 0 else end + 1
        else:
            name = _NAME.match(page, open_ + 1)
            tag, have, at = name.group().lower(), {}, name.end()
            while found := _ATTRIBUTE.match(page, at):
                value = next((v for v in found.groups()[1:] if v is not None), "")
                have[found.group(1).lower()] = attribute_text(value)
                at = found.end()
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
            yield "start", tag, have
            if tag in _ENDS:
                close = _ENDS[tag].search(page, at)
                end = close.start() if close else n
                if tag in _PLAIN and end > at:
                    yield "text", unescape(page[at:end]), None
                at = end
