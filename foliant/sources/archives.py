"""EPUB and DOCX files as tables.

Files are read with Spark's binaryFile source, one row a file, and taken apart in Arrow batches by the standard library; a book is the
unit of work, as an archive can only be read whole. Missing pages are skipped; an archive that cannot be read gives no rows here and
one row, with the reason, in read_refused.
"""

from __future__ import annotations

import html.parser
import io
import posixpath
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN = "struct<text:string,formatting:struct<bold:boolean,italic:boolean,underline:boolean,superscript:boolean,subscript:boolean,font_name:string,font_size:double,font_color:string>>"
PARAGRAPHS = f"doc_id string, pos int, paragraph_id string, idref string, text string, heading_level int, all_bold boolean, alignment string, css_class string, images array<string>, runs array<{RUN}>"
PAGES = "doc_id string, pos int, idref string, path string, html string, stylesheets array<string>"
PICTURES = "doc_id string, pos int, k int, name string, content binary"
REFUSED = "doc_id string, suffix string, reason string"
MEMBERS = "doc_id string, pos int, name string, size bigint, stored boolean, content binary"
MANIFEST = "doc_id string, item_id string, href string, path string, media_type string, properties string"
SPINE = "doc_id string, pos int, idref string, linear string, is_nav boolean"
METADATA = "doc_id string, opf_path string, version string, name string, value string, k int"

_INLINE = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "sup": "superscript", "sub": "subscript"}
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_FLAGS = ("bold", "italic", "underline", "superscript", "subscript")


def join_path(base: str, relative: str) -> str:
    """A link inside an archive, as the member's name; leaving the archive stops at its root."""
    parts: list[str] = []
    for p in [*base.split("/"), *urllib.parse.unquote(relative.split("#")[0]).split("/")]:
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2]


class _Blocks(html.parser.HTMLParser):
    """Paragraphs and headings of a page in order, empty ones too; an unclosed one ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.now: dict | None = None
        self.styles: list[str] = []
        self.links: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "link" and "stylesheet" in (a.get("rel") or "").split() and a.get("href"):
            self.links.append(a["href"])
        elif tag in _BLOCKS:
            style = re.search(r"text-align\s*:\s*(\w+)", a.get("style") or "")
            self.now = {"runs": [], "level": int(tag[1]) if tag != "p" else None, "class": a.get("class"), "align": a.get("align") or (style and style.group(1)), "images": []}
            self.out.append(self.now)
        elif tag == "img" and self.now is not None and a.get("src"):
            self.now["images"].append(a["src"])
        elif tag in _INLINE:
            self.styles.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS:
            self.now = None
        elif tag in _INLINE and tag in self.styles:
            del self.styles[len(self.styles) - 1 - self.styles[::-1].index(tag)]

    def handle_data(self, data):
        text = re.sub(r"\s+", " ", data)
        if self.now is not None and not self.skip and text and (text != " " or self.now["runs"]):
            on = {_INLINE[t] for t in self.styles}
            self.now["runs"].append((text, {f: f in on for f in _FLAGS}))


class _Spans(_Blocks):
    """As _Blocks, with where the inside of each block begins and ends in the page."""

    def __init__(self, page: str):
        super().__init__()
        self.lines = [0]
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.spans: list[list[int | None]] = []
        self.open = False

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self) -> None:
        if self.open:
            self.spans[-1][1] = self._at()
            self.open = False

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._shut()
            self.spans.append([self._at() + len(self.get_starttag_text() or ""), None])
            self.open = True
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _BLOCKS or tag in ("body", "html", "div"):
            self._shut()
        super().handle_endtag(tag)


def replace_blocks(page: str, inside: list[str | None]) -> str:
    """A page with the insides of its paragraphs and headings, in order, replaced by markup; a null leaves one as it is."""
    p = _Spans(page)
    p.feed(page)
    p.close()
    out, at = [], 0
    for (start, stop), new in zip(p.spans, inside):
        stop = len(page) if stop is None else stop
        if new is not None and start >= at:
            out += [page[at:start], new]
            at = stop
    return "".join([*out, page[at:]])


def page_blocks(page: str) -> _Blocks:
    p = _Blocks()
    p.feed(page)
    p.close()
    return p


def _run(text: str, flags: dict, font: str | None = None, size: float | None = None, color: str | None = None) -> dict:
    return {"text": text, "formatting": {**{f: bool(flags.get(f)) for f in _FLAGS}, "font_name": font, "font_size": size, "font_color": color}}


def _row(doc: str, pos: int, idref: str | None, runs: list[dict], level: int | None, align: str | None, css: str | None, images: list[str]) -> tuple:
    shown = [r for r in runs if r["text"].strip()]
    bold = bool(shown) and level is None and all(r["formatting"]["bold"] for r in shown)
    return doc, pos, f"p{pos:04d}", idref, "".join(r["text"] for r in runs), level, bold, align, css, images, runs


class Epub:
    """One opened EPUB archive."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        root = ET.fromstring(self.zip.read("META-INF/container.xml"))
        paths = [e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile" and e.get("full-path")]
        if not paths:
            raise ValueError("container without rootfile")
        self.opf_path = paths[0]
        self.package = ET.fromstring(self.zip.read(self.opf_path))
        base = posixpath.dirname(self.opf_path)
        self.manifest: dict[str, dict] = {}
        for e in self.package.iter():
            if _local(e.tag) == "item" and e.get("id"):
                href = e.get("href") or ""
                self.manifest[e.get("id")] = {"href": href, "path": join_path(base, href), "media_type": e.get("media-type"), "properties": e.get("properties") or ""}
        self.spine = [(e.get("idref"), e.get("linear")) for e in self.package.iter() if _local(e.tag) == "itemref" and e.get("idref")]

    def metadata(self) -> list[tuple[str, str]]:
        meta = next((e for e in self.package if _local(e.tag) == "metadata"), None)
        return [] if meta is None else [(_local(e.tag), (e.text or "").strip()) for e in meta if str(e.tag).startswith("{http://purl.org/dc/elements/1.1/}")]

    def page(self, idref: str) -> str | None:
        item = self.manifest.get(idref)
        try:
            return self.zip.read(item["path"]).decode("utf-8", "replace") if item else None
        except KeyError:
            return None

    def paragraphs(self, doc: str) -> Iterator[tuple]:
        pos = 0
        for idref, _ in self.spine:
            page = self.page(idref)
            for b in page_blocks(page).out if page is not None else ():
                yield _row(doc, pos, idref, [_run(t, f) for t, f in b["runs"]], b["level"], b["align"], b["class"], b["images"])
                pos += 1


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_paragraphs(doc: str, data: bytes) -> Iterator[tuple]:
    """Paragraphs of a DOCX body, empty ones too. First-level headings count only where a document has two or more."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = ET.fromstring(z.read("word/document.xml"))
    try:
        rels = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    except KeyError:
        rels = {}
    rows = []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = re.sub(r"[\s_-]", "", (style.get(f"{_W}val") if style is not None else "") or "").lower()
        jc = p.find(f"{_W}pPr/{_W}jc")
        runs = []
        for r in p.iter(f"{_W}r"):
            text = "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in r)
            if not text:
                continue
            pr = r.find(f"{_W}rPr")
            on = lambda tag, pr=pr: pr is not None and (e := pr.find(f"{_W}{tag}")) is not None and (e.get(f"{_W}val") or "1") not in ("0", "false", "none")
            value = lambda tag, key, pr=pr: e.get(f"{_W}{key}") if pr is not None and (e := pr.find(f"{_W}{tag}")) is not None else None
            up = value("vertAlign", "val")
            size = value("sz", "val")
            flags = {"bold": on("b"), "italic": on("i"), "underline": on("u"), "superscript": up == "superscript", "subscript": up == "subscript"}
            runs.append(_run(text, flags, value("rFonts", "ascii"), float(size) / 2 if size else None, value("color", "val")))
        images = [rels.get(b.get(f"{_R}embed"), "") for b in p.iter(f"{_A}blip")]
        rows.append((name in ("heading1", "judul1"), runs, jc.get(f"{_W}val") if jc is not None else None, name or None, images))
    leveled = sum(r[0] for r in rows) >= 2
    for pos, (head, runs, align, name, images) in enumerate(rows):
        yield _row(doc, pos, None, runs, 1 if head and leveled else None, align, name, images)


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("doc_id"), "content")


_UNREADABLE = (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, EOFError, zlib.error)


def _each(df: DataFrame, schema: str, rows_of) -> DataFrame:
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, data in zip(b["doc_id"], b["content"]):
                try:
                    out += list(rows_of(doc, bytes(data)))
                except _UNREADABLE:
                    continue  # read_refused has it
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a file or of all files in a folder, by suffix .epub or .docx; other suffixes are refused."""
    suffix = Path(path).suffix.lower().lstrip(".")
    if suffix and suffix not in ("epub", "docx"):
        raise ValueError(f"neither EPUB nor DOCX: {path}")
    wanted = [suffix] if suffix else ["epub", "docx"]
    parts = [_each(_files(spark, path, s), PARAGRAPHS, docx_paragraphs if s == "docx" else lambda d, x: Epub(x).paragraphs(d)) for s in wanted]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a spine as they are, with the members that their stylesheet links name."""
    def rows(d: str, x: bytes):
        e = Epub(x)
        for k, (i, _) in enumerate(e.spine):
            page = e.page(i)
            if page is not None:
                at = e.manifest[i]["path"]
                yield d, k, i, at, page, [join_path(posixpath.dirname(at), h) for h in page_blocks(page).links]

    return _each(_files(spark, path, "epub"), PAGES, rows)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of DOCX paragraphs, in order; a part without a suffix counts as PNG."""
    def rows(d: str, x: bytes):
        z = zipfile.ZipFile(io.BytesIO(x))
        for row in docx_paragraphs(d, x):
            for k, target in enumerate(row[9]):
                try:
                    data = z.read(join_path("word", target))
                except KeyError:
                    continue
                name = posixpath.basename(target)
                yield d, row[1], k, name if "." in name else f"{name}.png", data

    return _each(_files(spark, path, "docx"), PICTURES, rows)


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, suffix, reason): archives that cannot be read as a book."""
    def tried(suffix: str, rows_of):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for doc, data in zip(b["doc_id"], b["content"]):
                    try:
                        for _ in rows_of(doc, bytes(data)):
                            pass
                    except _UNREADABLE as e:
                        out.append((doc, suffix, f"{type(e).__name__}: {e}"[:200]))
                yield pd.DataFrame(out, columns=["doc_id", "suffix", "reason"])

        return _files(spark, path, suffix).mapInPandas(run, REFUSED)

    return tried("epub", lambda d, x: Epub(x).paragraphs(d)).unionByName(tried("docx", docx_paragraphs))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _each(_files(spark, path, "epub"), MANIFEST, lambda d, x: ((d, i, m["href"], m["path"], m["media_type"], m["properties"]) for i, m in Epub(x).manifest.items()))


def read_spine(spark: SparkSession, path: str) -> DataFrame:
    def rows(d: str, x: bytes):
        e = Epub(x)
        for k, (i, linear) in enumerate(e.spine):
            yield d, k, i, linear, "nav" in e.manifest.get(i, {}).get("properties", "").split()

    return _each(_files(spark, path, "epub"), SPINE, rows)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Dublin Core elements one a row; the first title and the first creator (least k) name the book."""
    def rows(d: str, x: bytes):
        e = Epub(x)
        for k, (n, v) in enumerate(e.metadata()):
            yield d, e.opf_path, e.package.get("version"), n, v, k

    return _each(_files(spark, path, "epub"), METADATA, rows)


def read_members(spark: SparkSession, path: str, suffix: str = "epub") -> DataFrame:
    def rows(d: str, x: bytes):
        with zipfile.ZipFile(io.BytesIO(x)) as z:
            for k, i in enumerate(z.infolist()):
                yield d, k, i.filename, i.file_size, i.compress_type == zipfile.ZIP_STORED, z.read(i)

    return _each(_files(spark, path, suffix), MEMBERS, rows)
