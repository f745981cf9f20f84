"""HTML pages to plain text with tables as Markdown and images as markers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = {"script", "style", "noscript"}
BREAKS = {"p", "div", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title", "blockquote", "pre", "dt", "dd", "a"}
#: Images with a numeric width or height below this are left out.
LEAST_PIXELS = 100


def markdown(rows: list[list[str]]) -> str:
    """As functions.tables.table_markdown, for rows inside the parser."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    clean = [[" ".join(c.split("\n")).strip() for c in r] + [""] * (width - len(r)) for r in rows]
    head = clean[0] if any(clean[0]) else [f"Columna {i}" for i in range(1, width + 1)]
    body = [r for r in clean[1:] if any(r)] or [[""] * width]
    return "\n".join(" | ".join(r) for r in (head, ["---"] * width, *body))


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.title = ""
        self._line: list[str] = []
        self._skip = 0
        self._table: list[list[str]] | None = None
        self._depth = self._tables = self._images = 0
        self._in_title = self._cell = False

    def _close(self) -> None:
        if line := " ".join("".join(self._line).split()):
            self.blocks.append(line)
        self._line = []

    def _close_cell(self) -> None:
        """A cell ends with its tag, or where the next cell, row or the table's end begins."""
        if self._cell and self._table:
            self._table[-1].append(" ".join("".join(self._line).split()))
            self._line = []
        self._cell = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self._skip += 1
        elif tag == "table":
            self._depth += 1
            if self._depth == 1:
                self._close()
                self._table = []
        elif self._table is not None and tag == "tr":
            self._close_cell()
            self._table.append([])
        elif self._table is not None and tag in ("td", "th"):
            self._close_cell()
            self._line, self._cell = [], True
        elif tag == "img":
            self._image(dict(attrs))
        elif tag in BREAKS and self._table is None:
            self._close()
        self._in_title |= tag == "title"

    def _image(self, attrs: dict[str, str | None]) -> None:
        sizes = [(attrs.get(k) or "").strip().removesuffix("px") for k in ("width", "height")]
        if any(s.isdigit() and 0 < int(s) < LEAST_PIXELS for s in sizes):
            return
        self._images += 1
        self._close()
        self.blocks.append(f"[IMAGEN (img {self._images})]: sin descripción disponible.")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag in ("td", "th", "tr") and self._table:
            self._close_cell()
        elif tag == "table" and self._depth:
            self._close_cell()
            self._depth -= 1
            if not self._depth:
                self._tables += 1
                body = markdown(self._table or [])
                self.blocks.append(f"[BLOQUE DELIMITADO {self._tables} INICIO]\n{body}\n[BLOQUE DELIMITADO {self._tables} FIN]")
                self._table, self._line = None, []
        elif tag in BREAKS and self._table is None:
            self._close()
        self._in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif not self._skip:
            self._line.append(data)

    def text(self) -> str:
        self._close()
        return with_title_first("\n\n".join(self.blocks), " ".join(self.title.split()))


def with_title_first(body: str, title: str) -> str:
    """The title before the body; if it comes late in the body, what stands there moves to the front."""
    if not title:
        return body
    at = body.rfind(title)
    if at > len(body) / 3:
        start = body.rfind("\n\n", 0, at)
        start = 0 if start < 0 else start + 2
        body = body[start:] + "\n\n" + body[:start].rstrip("\n") if start else body
    return body if body.startswith(title) else f"{title}\n\n{body}"


def page_text(html: str | None) -> str:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader.text()


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the column text instead of their markup; rows are independent, so no shuffle."""
    keep = [c for c in pages.columns if c != html]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            yield part[keep].assign(text=part[html].map(page_text))

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string"])
    return pages.mapInPandas(run, schema)
