"""HTML pages to blocks, with a parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that end a block, that hold no text, and heading ranks.
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 table ul ol section article header footer blockquote br".split())
SILENT = frozenset("script style nav noscript template".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list[str]]] = []
        self.path: list[tuple[int, str]] = []
        self.words: list[str] = []
        self.kind, self.silent = "p", 0

    def close_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.kind[0] == "h" and self.kind[1:].isdigit():
            rank = int(self.kind[1:])
            self.path = [x for x in self.path if x[0] < rank] + [(rank, text)]
        self.blocks.append((self.kind, text, [x for _, x in self.path]))

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.close_block()
            self.kind = tag
        elif tag in ("td", "th"):
            self.words.append(" | " if "".join(self.words).strip() else "")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in BLOCKS:
            self.close_block()
            self.kind = "p"

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)


def read_blocks(html: str | None) -> list[tuple[str, str, list[str]]]:
    """(kind, text, heading path) of each block; scripts, styles and navigation are left out."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    return reader.blocks


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, ``pos``, ``tipo``, ``texto`` and ``ruta`` of each block of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *b) for k, page in batch.itertuples(index=False) for i, b in enumerate(read_blocks(page), 1)]
            yield pd.DataFrame(rows, columns=[key, "pos", "tipo", "texto", "ruta"])

    return pages.select(key, html).mapInPandas(read, f"`{key}` {kind}, pos int, tipo string, texto string, ruta array<string>")


def decode(raw: bytes, declared: str | None = None) -> str:
    """Bytes of a page as text: UTF-8 if valid and not plain ASCII, else the declared set (Latin-1 read as Windows-1252)."""
    try:
        text = raw.decode("utf-8")
        if not raw.isascii() or not declared:
            return text
    except UnicodeDecodeError:
        pass
    name = (declared or "cp1252").lower()
    name = "cp1252" if name in ("latin1", "latin-1", "iso-8859-1") else name
    try:
        return raw.decode(name)
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")
