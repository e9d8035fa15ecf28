"""EPUB packages: a binary scan into entry, manifest, spine, navigation and block tables, and a writer."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import fixed

from .html import parse

VERTICAL = re.compile(fixed.VERTICAL, re.I)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _find(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _name(e.tag) == name]


class Package:
    """One opened package. error is set where it cannot be read; its tables are empty then."""

    def __init__(self, data: bytes):
        self.error: str | None = None
        self.entries: list[tuple[int, str, bool, bytes]] = []
        self.items: list[tuple[str, str, str, str]] = []
        self.spine: list[str] = []
        self.meta: dict[str, str] = {}
        self.toc: list[tuple[int, str, str]] = []
        self.cover_ids: list[str] = []
        self.vertical = False
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                self._read(z)
        except (zipfile.BadZipFile, ET.ParseError, KeyError, UnicodeDecodeError) as e:
            self.error = f"{type(e).__name__}: {e}"

    def _read(self, z: zipfile.ZipFile) -> None:
        self.entries = [(n, i.filename, i.compress_type != zipfile.ZIP_STORED, z.read(i)) for n, i in enumerate(z.infolist())]
        self.files = {name: body for _, name, _, body in self.entries}
        if "META-INF/encryption.xml" in self.files:
            self.error = "encrypted"
            return
        roots = _find(ET.fromstring(self.files["META-INF/container.xml"]), "rootfile")
        self.opf = roots[0].get("full-path", "") if roots else ""
        self.base = posixpath.dirname(self.opf)
        root = ET.fromstring(self.files[self.opf])
        for e in _find(root, "item"):
            href = posixpath.normpath(posixpath.join(self.base, e.get("href", "")))
            self.items.append((e.get("id", ""), href, e.get("media-type", ""), e.get("properties", "")))
        self.spine = [e.get("idref", "") for e in _find(root, "itemref")]
        for field in ("title", "creator", "publisher", "language"):
            self.meta[field] = next(("".join(e.itertext()).strip() for e in _find(root, field)), "")
        self.cover_ids = [e.get("content", "") for e in _find(root, "meta") if e.get("name") == "cover"]
        self.vertical = any(VERTICAL.search(self.files[h].decode("utf-8", "replace")) for _, h, kind, _ in self.items if kind == "text/css" and h in self.files)
        self._toc()

    def _toc(self) -> None:
        nav = next((h for _, h, _, p in self.items if "nav" in p.split()), None)
        ncx = next((h for _, h, kind, _ in self.items if kind == "application/x-dtbncx+xml"), None)

        def walk(e: ET.Element, level: int, at: str) -> None:
            for child in e:
                name = _name(child.tag)
                if name == "a" and level:
                    self.toc.append((level, " ".join("".join(child.itertext()).split()), posixpath.normpath(posixpath.join(at, child.get("href", "")))))
                elif name == "navPoint":
                    label = next(("".join(x.itertext()).strip() for x in child if _name(x.tag) == "navLabel"), "")
                    src = next((x.get("src", "") for x in child if _name(x.tag) == "content"), "")
                    self.toc.append((level + 1, label, posixpath.normpath(posixpath.join(at, src))))
                walk(child, level + (name in ("ol", "navPoint")), at)

        if nav in self.files:
            for e in _find(ET.fromstring(self.files[nav]), "nav"):
                if any(v == "toc" for k, v in e.attrib.items() if _name(k) == "type"):
                    walk(e, 0, posixpath.dirname(nav))
        elif ncx in self.files:
            for e in _find(ET.fromstring(self.files[ncx]), "navMap"):
                walk(e, 0, posixpath.dirname(ncx))

    def blocks(self) -> Iterator[dict]:
        by_id = {i: h for i, h, _, _ in self.items}
        first = {}
        for _, title, href in self.toc:
            first.setdefault(href.partition("#")[0], title)
        for idref in self.spine:
            href = by_id.get(idref, "")
            if href in self.files:
                for b in parse(self.files[href].decode("utf-8", "replace")).blocks:
                    yield b | {"file": href, "toc_title": first.get(href)}


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Package files as (doc_id, content); the id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("doc_id"), "content")


def _table(packages: DataFrame, rows, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, data in zip(f["doc_id"], f["content"], strict=True):
                out = [(doc, *r) for r in rows(Package(bytes(data)))]
                yield pd.DataFrame(out, columns=names)

    return packages.select("doc_id", "content").mapInPandas(run, columns)


def documents(packages: DataFrame) -> DataFrame:
    one = lambda p: [(p.meta.get("title", ""), p.meta.get("creator", ""), p.meta.get("publisher", ""), p.meta.get("language", ""), p.vertical, len(p.spine), p.error)]
    return _table(packages, one, "doc_id string, title string, author string, publisher string, source_lang string, vertical boolean, spine_docs int, error string")


def entries(packages: DataFrame) -> DataFrame:
    return _table(packages, lambda p: [(n, name, packed, body[:64].decode("utf-8", "replace")) for n, name, packed, body in p.entries], "doc_id string, entry_no int, name string, compressed boolean, head string")


def items(packages: DataFrame) -> DataFrame:
    return _table(packages, lambda p: p.items, "doc_id string, item_id string, href string, media_type string, props string")


def spine(packages: DataFrame) -> DataFrame:
    return _table(packages, lambda p: list(enumerate(p.spine)), "doc_id string, pos int, idref string")


def toc(packages: DataFrame) -> DataFrame:
    rows = lambda p: [(n, level, title, href, *href.partition("#")[::2]) for n, (level, title, href) in enumerate(p.toc)]
    return _table(packages, rows, "doc_id string, pos int, level int, title string, href string, file string, frag string")


def covers(packages: DataFrame) -> DataFrame:
    return _table(packages, lambda p: [(c,) for c in p.cover_ids], "doc_id string, cover_id string")


def refs(packages: DataFrame) -> DataFrame:
    rows = lambda p: [(h, r) for _, h, kind, _ in p.items if kind == "application/xhtml+xml" and h in p.files for r in parse(p.files[h].decode("utf-8", "replace")).refs]
    return _table(packages, rows, "doc_id string, from_href string, ref string")


def blocks(packages: DataFrame) -> DataFrame:
    def rows(p: Package):
        for n, b in enumerate(p.blocks() if not p.error else (), 1):
            yield n, f"b{n:06d}", b["type"], b["level"], b["text"], b["file"], b["toc_title"], b.get("path"), b["note_id"], b["refs"], b.get("rows"), b.get("cell_spans")

    schema = "doc_id string, ord int, block_id string, type string, level int, text string, file string, toc_title string, path string, note_id string, refs array<string>, rows array<array<string>>, cell_spans array<array<array<int>>>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, data in zip(f["doc_id"], f["content"], strict=True):
                frame = pd.DataFrame([(doc, *r) for r in rows(Package(bytes(data)))], columns=names)
                frame["level"] = frame["level"].astype("Int64")
                yield frame

    return packages.select("doc_id", "content").mapInPandas(run, schema)


def build(files: list[tuple[str, bytes]], title: str, lang: str, cover: str | None = None) -> bytes:
    """A package from content files: mimetype first and stored, then container, package file and contents."""
    out = io.BytesIO()
    order = ([f for f in files if f[0] == cover] if cover else []) + [f for f in files if f[0] != cover]
    media = lambda n: "application/xhtml+xml" if n.endswith(".xhtml") else "text/css" if n.endswith(".css") else "image/png"
    props = lambda n: ' properties="nav"' if n == "nav.xhtml" else ' properties="cover-image"' if n == cover else ""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    manifest = "".join(f'<item id="i{k}" href="{n}" media-type="{media(n)}"{props(n)}/>' for k, (n, _) in enumerate(order))
    spine_refs = "".join(f'<itemref idref="i{k}"/>' for k, (n, _) in enumerate(order) if n.endswith(".xhtml"))
    opf = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"<dc:title>{esc(title)}</dc:title><dc:language>{lang}</dc:language></metadata><manifest>{manifest}</manifest><spine>{spine_refs}</spine></package>"
    )
    container = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", container)
        z.writestr("OEBPS/content.opf", opf)
        for n, body in order:
            z.writestr(f"OEBPS/{n}", body, zipfile.ZIP_STORED if media(n).startswith("image/") else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_packages(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, content: a package for each document. chapters: (doc_id, part, title, body); titles: (doc_id, title, lang)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        page = lambda t, body: f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{t or ""}</title></head><body>{body}</body></html>'.encode()
        files = [(f"text/ch{k:04d}.xhtml", page(t, b)) for k, t, b in zip(p["part"], p["title"], p["body"], strict=True)]
        links = "".join(f'<li><a href="{n}">{t or ""}</a></li>' for (n, _), t in zip(files, p["title"], strict=True))
        nav = page("nav", f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{links}</ol></nav>')
        return pd.DataFrame({"doc_id": [p["doc_id"].iloc[0]], "content": [build([("nav.xhtml", nav), *files], p["book"].iloc[0] or "", p["lang"].iloc[0] or "")]})

    kind = chapters.schema["doc_id"].dataType.simpleString()
    return chapters.join(titles.select("doc_id", F.col("title").alias("book"), "lang"), "doc_id").groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, content binary")
