"""Blocks of a word-processor file (zipped XML), in reading order: headings with levels, list items, table rows with merged cells, headers, footers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Unpacked bytes of a file's XML, at most.
MOST_BYTES = 256 << 20
#: Text of a run: characters, and what the other elements stand for (fixed values of the format).
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


class Block(NamedTuple):
    kind: str
    text: str
    level: int | None = None
    section: tuple[str, ...] = ()
    cells: tuple[str, ...] | None = None
    merged: int | None = None


class TooLarge(ValueError):
    pass


def _text(node: ElementTree.Element) -> str:
    """Text of a paragraph, deleted passages left out (their letters are in other elements)."""
    return "".join(x.text or "" if x.tag == f"{_W}t" else _MARKS.get(x.tag, "") for x in node.iter()).strip()


def _value(node: ElementTree.Element | None, path: str) -> str | None:
    found = node.find("/".join(f"{_W}{p}" for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(f"{_W}val", "")


class _File:
    def __init__(self, content: bytes, most: int):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.left = most
        self.names = set(self.zip.namelist())
        self.styles = {}
        if "word/styles.xml" in self.names:
            self.styles = {s.get(f"{_W}styleId"): (_value(s, "name") or "").lower() for s in self.xml("word/styles.xml").iter(f"{_W}style")}

    def xml(self, name: str) -> ElementTree.Element:
        self.left -= self.zip.getinfo(name).file_size
        if self.left < 0:
            raise TooLarge("too large when unpacked")
        return ElementTree.fromstring(self.zip.read(name))

    def targets(self) -> dict[str, str]:
        at = "word/_rels/document.xml.rels"
        if at not in self.names:
            return {}
        return {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target", ""))) for r in self.xml(at).iter(f"{_PACKAGE}Relationship")}

    def kind(self, p: ElementTree.Element) -> tuple[str, int | None]:
        """Kind and heading level of a paragraph by its style, outline and numbering."""
        style_id = _value(p, "pPr/pStyle") or ""
        style = self.styles.get(style_id, style_id.lower())
        outline = _value(p, "pPr/outlineLvl")
        if m := re.fullmatch(r"heading\s*([1-9])", style):
            return "heading", int(m[1])
        if style in ("title", "subtitle"):
            return "heading", 1 if style == "title" else 2
        if outline is not None and outline.isdigit() and int(outline) < 9:
            return "heading", int(outline) + 1
        if p.find(f"{_W}pPr/{_W}numPr") is not None or style.startswith("list"):
            return "list_item", int(_value(p, "pPr/numPr/ilvl") or 0) + 1
        return "paragraph", None


def _rows(table: ElementTree.Element) -> Iterator[tuple[tuple[str, ...], int]]:
    """(cells, merged) of each row: a cell over several columns or rows stands in each of them; ``merged`` counts those repeats."""
    above: dict[int, str] = {}
    for row in table.findall(f"{_W}tr"):
        cells: list[str] = []
        merged = 0
        for cell in row.findall(f"{_W}tc"):
            width = max(1, int(_value(cell, "tcPr/gridSpan") or 1))
            down = cell.find(f"{_W}tcPr/{_W}vMerge")
            goes_on = down is not None and down.get(f"{_W}val", "continue") != "restart"
            text = above.get(len(cells), "") if goes_on else "\n".join(x for p in cell.iter(f"{_W}p") if (x := _text(p)))
            merged += width - 1 + goes_on
            for _ in range(width):
                above[len(cells)] = text
                cells.append(text)
        yield tuple(cells), merged


def _children(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs, tables and section marks of a body, those in content controls included."""
    for child in node:
        if child.tag == f"{_W}sdt":
            if (inside := child.find(f"{_W}sdtContent")) is not None:
                yield from _children(inside)
        elif child.tag in (f"{_W}p", f"{_W}tbl", f"{_W}sectPr"):
            yield child


def blocks(content: bytes, most: int = MOST_BYTES) -> Iterator[Block]:
    """Headers of all sections, the body, then footers; each header or footer once. ``section`` holds the headings above a block, its own included.
    Blank blocks are left out. Raises ``BadZipFile``, ``KeyError``, ``ParseError`` or ``TooLarge`` for files that can't be read."""
    file = _File(content, most)
    body = file.xml("word/document.xml").find(f"{_W}body")
    if body is None:
        return
    targets = file.targets()

    def margin(kind: str) -> Iterator[Block]:
        for at in dict.fromkeys(targets.get(x.get(_REL)) for x in body.iter(f"{_W}{kind}Reference")):
            for p in file.xml(at).iter(f"{_W}p") if at in file.names else ():
                if text := _text(p):
                    yield Block(kind, text)

    yield from margin("header")
    headings: list[tuple[int, str]] = []
    for node in _children(body):
        section = tuple(x for _, x in headings)
        if node.tag == f"{_W}p" and (text := _text(node)):
            kind, level = file.kind(node)
            if kind == "heading":
                headings = [h for h in headings if h[0] < level] + [(level, text)]
                section = tuple(x for _, x in headings)
            yield Block(kind, text, level, section)
        elif node.tag == f"{_W}tbl":
            for cells, merged in _rows(node):
                if any(cells):
                    yield Block("table_row", " | ".join(x for x in cells if x), None, section, cells, merged)
    yield from margin("footer")
