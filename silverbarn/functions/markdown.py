"""HTML to Markdown, wrapped filings and text blocks, parsed in Arrow batches.

A page becomes an element tree first. The tree is then folded from its leaves:
every element turns into text once all its children have, so depth costs no
recursion.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import chain
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markdown around an element; emphasis around nothing is left out.
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "u": "*"}
AROUND = {"span": (" ", " "), "br": ("\n", ""), "p": ("\n\n", "\n\n"), "div": ("\n\n", "\n\n"), "ul": ("\n", ""), "ol": ("\n", ""), "li": ("- ", "\n")}
#: Elements without content.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that an opening tag closes, and the one that holds them.
CLOSED_BY = {"td": (("td", "th"), "table"), "th": (("td", "th"), "table"), "tr": (("tr",), "table")}


class _Tree(HTMLParser):
    """The page as an ElementTree under one root."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.root = ElementTree.Element("page")
        self.path = [self.root]
        self.feed(html)
        self.close()
        for node in self.path:
            if node.tag == "table":  # never closed: nothing of it counts
                node.clear()

    def _leave(self, tags, within: str | None = None) -> None:
        """Closes the innermost open element of these tags, unless ``within`` is open inside it."""
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].tag in tags:
                del self.path[depth:]
                return
            if self.path[depth].tag == within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY:
            self._leave(*CLOSED_BY[tag])
        node = ElementTree.SubElement(self.path[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        self._leave((tag,))

    def handle_data(self, data):
        here = self.path[-1]
        if len(here):
            here[-1].tail = (here[-1].tail or "") + data
        else:
            here.text = (here.text or "") + data


def _span(node, name: str) -> int:
    text = node.get(name, "").strip()
    return min(1000, max(1, int(text))) if re.fullmatch("[0-9]{1,9}", text) else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells laid out by column and row spans; a spanned place is empty."""
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, wide, high in row:
            while (r, c) in taken:
                c += 1
            for dr in range(high):
                for dc in range(wide):
                    taken[r + dr, c + dc] = text if not dr and not dc else ""
            c += wide
    height = max((r for r, _ in taken), default=-1) + 1
    width = [max((c for r, c in taken if r == k), default=-1) + 1 for k in range(height)]
    return [[taken.get((r, c), "") for c in range(width[r])] for r in range(height)]


def _parts(table, tags: tuple[str, ...]) -> list:
    """Elements of these tags inside an element, in order, those of inner tables left out."""
    found, todo = [], list(reversed(table))
    while todo:
        node = todo.pop()
        if node.tag in tags:
            found.append(node)
        elif node.tag != "table":
            todo += reversed(node)
    return found


def _table(table, plain: dict) -> str:
    """A pipe table: the first row is its head, cells are plain text."""
    cells = lambda row: [(plain[c].strip(), _span(c, "colspan"), _span(c, "rowspan")) for c in _parts(row, ("td", "th"))]
    grid = _grid([cells(row) for row in _parts(table, ("tr",))])
    if not grid or not grid[0]:
        return ""
    wide = len(grid[0])
    lines = [grid[0], ["---"] * wide, *(row + [""] * (wide - len(row)) for row in grid[1:])]
    return "\n" + "".join(f"| {' | '.join(line)} |\n" for line in lines)


def _shown(node, inner: str) -> str:
    if node.tag in EMPHASIS:
        sign = EMPHASIS[node.tag]
        return f"{sign}{inner}{sign}" if inner.strip() else inner
    before, after = AROUND.get(node.tag, ("", ""))
    return before + inner + after


def to_markdown(html: str) -> str:
    """Markdown of a page: scripts dropped, at most one blank line in a row, no blanks at line ends.

    A table within a table's cell stands before the outer one.
    """
    root = _Tree(html).root
    shown, plain, inner_tables = {}, {}, {}
    # the reverse of document order meets every element after all its descendants
    for node in reversed(list(root.iter())):
        text = node.text or ""
        tables = "".join(inner_tables.pop(c) for c in node)
        pick = lambda of: text + "".join(chain.from_iterable((of[c], c.tail or "") for c in node))  # noqa: B023, E731
        plain[node] = "" if node.tag in ("script", "table") else pick(plain)
        if node.tag == "script":
            shown[node], tables = "", ""
        elif node.tag == "table":
            tables = shown[node] = tables + _table(node, plain)
        else:
            shown[node] = _shown(node, pick(shown))
        inner_tables[node] = tables
    lines = "\n".join(line.rstrip() for line in shown[root].splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


_DOCUMENT = re.compile(r"<document>(.*?)(?:</document>|\Z)", re.I | re.S)
_BODY = re.compile(r"<text>(.*?)(?:</text>|\Z)", re.I | re.S)


def _header(document: str, name: str) -> str:
    """Value of a header line, with or without a closing tag."""
    found = re.search(rf"<{name}>([^<\r\n]*)", document, re.I)
    return found.group(1).strip() if found else ""


def _section(document: str) -> str:
    description, body = _header(document, "description"), _BODY.search(document)
    title = f"### {_header(document, 'filename') or 'unknown'} (sequence {_header(document, 'sequence')})\n"
    return title + (f"Description: {description}\n" if description else "") + (to_markdown(body.group(1)) if body else "") + "\n---"


def wrapped_to_markdown(text: str) -> str:
    """Every document of type XML of a wrapped filing as a section of its own.

    Without one, the body of the first document, else the text as a page.
    """
    documents = _DOCUMENT.findall(text)
    sections = [_section(d) for d in documents if _header(d, "type").upper() == "XML"]
    if sections:
        return "\n".join(sections)
    body = _BODY.search(documents[0]) if documents else None
    return to_markdown(body.group(1) if body and body.group(1).strip() else text)


def textblocks_to_markdown(xml: str) -> str:
    """The content of every element whose name holds 'textblock' as Markdown; the rest unchanged."""
    root = ElementTree.fromstring(xml)
    blocks = [n for n in root.iter() if "textblock" in n.tag.partition("}")[2].lower() or "}" not in n.tag and "textblock" in n.tag.lower()]
    for block in reversed(blocks):
        html = (block.text or "") + "".join(ElementTree.tostring(c, "unicode", "html") for c in block)
        if html.strip():
            block[:] = []
            block.text = to_markdown(html)
    return ElementTree.tostring(root, "unicode")


def _column(convert):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def safe(t):
            try:
                return None if t is None else convert(t)
            except ElementTree.ParseError:
                return None

        return texts.map(safe)

    return run


def markdown(html: Column) -> Column:
    """Markdown of an HTML text; null for null."""
    return _column(to_markdown)(html)


def wrapped_markdown(text: Column) -> Column:
    return _column(wrapped_to_markdown)(text)


def textblock_markdown(xml: Column) -> Column:
    """Null for text that is no XML."""
    return _column(textblocks_to_markdown)(xml)


def links(html: Column) -> Column:
    """Targets of the anchors that name no directory, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), 1)
    return F.array_distinct(F.filter(found, lambda h: ~F.endswith(h, F.lit("/"))))
