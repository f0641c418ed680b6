"""Visible lines of an HTML page, with heading levels where asked for."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is left out, what ends a line, what separates cells.
UNSEEN = frozenset(["script", "style", "noscript", "svg", "template", "head", "title"])
LINE_ENDS = frozenset(["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "div", "section", "article"])
CELLS = frozenset(["td", "th"])
HIDDEN_CLASS = "w-condition-invisible"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# End of fixed values.


class LineScanner(HTMLParser):
    """Collects (line, heading level or None); text of unseen and hidden elements is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int | None]] = []
        self._parts: list[str] = []
        self._open: list[tuple[str, bool, int | None]] = []
        self._level: int | None = None

    def _unseen(self) -> bool:
        return bool(self._open) and self._open[-1][1]

    def _end_line(self) -> None:
        text = " ".join(unicodedata.normalize("NFKC", "".join(self._parts)).split())
        if text:
            self.lines.append((text, self._level))
        self._parts, self._level = [], None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            if any(level is not None for _, _, level in self._open):
                self._parts.append(" ")  # a heading over two lines is one heading
            else:
                self._end_line()
            return
        if tag in VOID:
            return
        if tag == "li" or tag == "p":
            self._close(tag, {"ul", "ol", "div", "section", "article", "table", "body"})
        attributes = {k: v or "" for k, v in attrs}
        unseen = self._unseen() or tag in UNSEEN or HIDDEN_CLASS in attributes.get("class", "").split()
        level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else None
        if level is None and attributes.get("role") == "heading":
            level = int(attributes["aria-level"]) if attributes.get("aria-level", "").isdigit() else 2
        if level is not None:
            self._end_line()
        self._open.append((tag, unseen, level))

    def _close(self, tag: str, stop: set[str]) -> None:
        for at in range(len(self._open) - 1, -1, -1):
            name = self._open[at][0]
            if name == tag:
                while len(self._open) > at:
                    self._pop()
                return
            if name in stop:
                return

    def _pop(self) -> None:
        tag, unseen, level = self._open.pop()
        if unseen:
            return
        if level is not None:
            self._level = level
            self._end_line()
        elif tag in LINE_ENDS:
            self._end_line()
        elif tag in CELLS:
            self._parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, set())

    def handle_data(self, data: str) -> None:
        if not self._unseen():
            first, *rest = data.split("\n")
            self._parts.append(first)
            for line in rest:
                if self._open and self._open[-1][2] is not None:
                    self._parts.append(" ")
                else:
                    self._end_line()
                self._parts.append(line)

    def close(self) -> None:
        super().close()
        while self._open:
            self._pop()
        self._end_line()


def annotated_lines(page: str | None) -> list[tuple[str, int | None]]:
    scanner = LineScanner()
    scanner.feed(page or "")
    scanner.close()
    return scanner.lines


def visible_lines(page: str | None) -> list[str]:
    return [line for line, _ in annotated_lines(page)]


def visible_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, visible_text): the page's lines, NFKC and squeezed, blank ones dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(visible_lines(t)) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "visible_text"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` long, visible_text string")
