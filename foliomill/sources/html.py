"""Blocks, tables and references from HTML and XHTML, by a tolerant parser in Arrow batches.

Real pages are no well-formed XML, so XPath expressions cannot read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import fixed

HEADS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
SKIP = {"script", "style", "rt", "title"}
FLOW = {"p", "li", "aside", "figcaption", "caption", "blockquote", "dt", "dd", *HEADS}
_SPACE = re.compile(r"[\s\u3000]+")
_HEAD_CLASS = re.compile(fixed.HEAD_CLASS, re.I)
_NOTE = re.compile(r"footnote|endnote|rearnote", re.I)


class BlockParser(HTMLParser):
    """Collects blocks in order: type, level, text, id, refs, path, rows and spans of cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.tags: list[tuple[str, str]] = []
        self.refs: list[str] = []
        self.ids: list[tuple[str, str]] = []
        self.ruby = 0
        self._skip = 0
        self._text: list[str] = []
        self._kind, self._level, self._id, self._links = "", None, None, []
        self._by_class = False  # a heading by its class only
        self._table: dict | None = None
        self._caption: list[str] | None = None
        self._cell: list[str] | None = None
        self._note: dict | None = None

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        self._text = []
        if self._by_class and len(text) > fixed.HEAD_LENGTH:
            self._kind, self._level = "paragraph", None
        self._by_class = False
        if text and self._kind and self._kind != "div":
            self.blocks.append({"type": self._kind, "level": self._level, "text": text, "note_id": self._id if self._kind == "footnote" else None, "refs": self._links})
        self._kind, self._level, self._id, self._links = "", None, None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.tags.append((tag, a.get("class", "")))
        if "id" in a:
            self.ids.append((a["id"], ""))
        for k in ("href", "src", "xlink:href"):
            if k in a:
                self.refs.append(a[k])
        if tag == "rt":
            self.ruby += 1
        if tag in SKIP:
            self._skip += 1
        elif tag == "table":
            self._flush()
            self._table = {"type": "table", "level": None, "text": "", "note_id": None, "refs": [], "caption": None, "rows": [], "cell_spans": []}
        elif self._table is not None:
            if tag == "tr":
                self._table["rows"].append([])
                self._table["cell_spans"].append([])
            elif tag in ("td", "th"):
                self._cell = []
                if not self._table["rows"]:
                    self._table["rows"].append([])
                    self._table["cell_spans"].append([])
                self._table["cell_spans"][-1].append([_span(a.get("rowspan")), _span(a.get("colspan"))])
            elif tag == "caption":
                self._caption = []
        elif tag == "img" or (tag == "image" and "xlink:href" in a):
            self._flush()
            self.blocks.append({"type": "image", "level": None, "text": "", "note_id": None, "refs": [], "path": a.get("src") or a.get("xlink:href")})
        elif tag in FLOW and not (self._kind == "footnote" and tag == "p"):
            self._flush()
            note = _NOTE.search(a.get("epub:type", "") + " " + a.get("role", "") + " " + a.get("class", ""))
            heads = any(b["type"] == "heading" for b in self.blocks)
            if tag in HEADS:
                self._kind, self._level = "heading", HEADS[tag]
            elif note or tag == "aside":
                self._kind = "footnote"
            elif _HEAD_CLASS.search(a.get("class", "")) and not heads:
                self._kind, self._level, self._by_class = "heading", 1, True
            else:
                self._kind = "paragraph"
            self._id = a.get("id")
        elif tag == "div" and self._kind in ("", "div"):
            self._flush()  # text of a div with a div or another block inside is no paragraph
            self._kind, self._id = "div", a.get("id")
        elif tag == "br" and self._text:
            self._text.append(" ")
        if tag == "a" and a.get("href", "").startswith("#"):
            self._links.append(a["href"][1:])

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self._skip = max(0, self._skip - 1)
        elif self._table is not None:
            if tag in ("td", "th") and self._cell is not None:
                self._table["rows"][-1].append(_SPACE.sub(" ", "".join(self._cell)).strip())
                self._cell = None
            elif tag == "caption" and self._caption is not None:
                self._table["caption"] = _SPACE.sub(" ", "".join(self._caption)).strip() or None
                self._caption = None
            elif tag == "table":
                self.blocks.append(self._table)
                self._table = None
        elif tag == "div" and self._kind == "div":
            self._kind = "paragraph"
            self._flush()
        elif tag in FLOW and not (self._kind == "footnote" and tag == "p"):
            self._flush()

    def handle_data(self, data: str) -> None:
        if self._skip:
            return
        if self.ids and not self.ids[-1][1] and data.strip():
            self.ids[-1] = (self.ids[-1][0], _SPACE.sub(" ", data).strip())
        if self._cell is not None:
            self._cell.append(data)
        elif self._caption is not None:
            self._caption.append(data)
        elif self._kind:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        if self._table is not None:
            self.blocks.append(self._table)
            self._table = None
        self._flush()


def _span(value: str | None) -> int:
    try:
        return max(1, int(value or 1))
    except ValueError:
        return 1


def parse(html: str | None) -> BlockParser:
    p = BlockParser()
    p.feed(html or "")
    p.close()
    return p


BLOCKS = "{id} {kind}, ord int, type string, level int, text string, note_id string, refs array<string>, path string, caption string, rows array<array<string>>, cell_spans array<array<array<int>>>"


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The blocks of every page, in order."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, html in zip(f["id"], f["html"], strict=True):
                for n, b in enumerate(parse(html).blocks, 1):
                    out.append((key, n, b["type"], b["level"], b["text"], b["note_id"], b["refs"], b.get("path"), b.get("caption"), b.get("rows"), b.get("cell_spans")))
            frame = pd.DataFrame(out, columns=[id_col, "ord", "type", "level", "text", "note_id", "refs", "path", "caption", "rows", "cell_spans"])
            frame["level"] = frame["level"].astype("Int64")
            yield frame

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, BLOCKS.format(id=id_col, kind=kind))


def html_refs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, tag, ref) from attributes, without a parser: href and src values."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r'(?:href|src)="([^"]*)"'), F.lit(1))
    return pages.select(F.col(id_col), F.posexplode(found).alias("pos", "ref"))


def tag_profile(pages: DataFrame, html_col: str = "html", top: int = 14) -> DataFrame:
    """The most frequent opening tags with their class."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))
    return pages.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(top)
