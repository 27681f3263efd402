"""Books and state written back: EPUB and DOCX archives, glossary files, JSON state with a backup of what it replaces.

A book is written by one task, from its rows in order, as an archive is one file: a task needs the memory of one book. The rows of a
book meet in that task only as the markup of its chapters or pages.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import time
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources.archives import Epub, join_path, page_blocks, replace_blocks


def _escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def run_markup(run: Column) -> Column:
    """A run as XHTML: escaped, in sup or else sub, then strong, em and u around it."""
    f, out = run["formatting"], _escaped(F.coalesce(run["text"], F.lit("")))
    on = lambda k: F.coalesce(f[k], F.lit(False))
    out = F.when(on("superscript"), F.concat(F.lit("<sup>"), out, F.lit("</sup>"))).when(on("subscript"), F.concat(F.lit("<sub>"), out, F.lit("</sub>"))).otherwise(out)
    for key, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u")):
        out = F.when(on(key), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return out


def paragraph_markup(level: Column, runs: Column) -> Column:
    tag = F.when(level.isNull(), "p").otherwise(F.concat(F.lit("h"), level.cast("string")))
    body = F.array_join(F.transform(runs, run_markup), "")
    return F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))


def chapter_pages(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, title, page): XHTML pages of chapters from (doc_id, chapter_no, title, pos, heading_level, runs)."""
    rows = paragraphs.select("doc_id", "chapter_no", "title", "pos", paragraph_markup(F.col("heading_level"), F.col("runs")).alias("m"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]), "\n")
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="id"><head><title>'), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title></head><body>\n"))
    return rows.groupBy("doc_id", "chapter_no").agg(F.max("title").alias("title"), body.alias("body")).select("doc_id", "chapter_no", "title", F.concat(head, "body", F.lit("\n</body></html>")).alias("page"))


def epub_bytes(title: str, pages: list[tuple[int, str, str]], extra: dict[str, bytes] | None = None) -> bytes:
    """An EPUB 3 archive of (chapter number, title, page), mimetype first and stored."""
    e = html.escape
    items = "".join(f'<item id="c{n:04d}" href="c{n:04d}.xhtml" media-type="application/xhtml+xml"/>' for n, _, _ in pages)
    spine = "".join(f'<itemref idref="c{n:04d}"/>' for n, _, _ in pages)
    nav = "".join(f'<li><a href="c{n:04d}.xhtml">{e(t or "")}</a></li>' for n, t, _ in pages)
    opf = (f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
           f'<dc:identifier id="id">{e(title)}</dc:identifier><dc:title>{e(title)}</dc:title><dc:language>id</dc:language></metadata><manifest>'
           f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>')
    page = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{e(title)}</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>'
    box = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", box)
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/nav.xhtml", page)
        for n, _, x in pages:
            z.writestr(f"OEBPS/c{n:04d}.xhtml", x)
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def docx_bytes(paragraphs: list[tuple], pictures: dict[int, list[tuple[str, bytes]]] | None = None) -> bytes:
    """A DOCX archive of (heading level, runs) or (heading level, runs, alignment); `pictures` has those of a paragraph by its number."""
    e = html.escape

    def run(r: dict) -> str:
        f = r.get("formatting") or {}
        props = "".join(x for k, x in (("bold", "<w:b/>"), ("italic", "<w:i/>"), ("underline", '<w:u w:val="single"/>')) if f.get(k))
        if f.get("superscript") or f.get("subscript"):
            props += f'<w:vertAlign w:val="{"superscript" if f.get("superscript") else "subscript"}"/>'
        if f.get("font_name"):
            props += f'<w:rFonts w:ascii="{e(f["font_name"])}"/>'
        if f.get("font_size") is not None and f["font_size"] == f["font_size"]:
            props += f'<w:sz w:val="{round(f["font_size"] * 2)}"/>'
        if f.get("font_color"):
            props += f'<w:color w:val="{e(f["font_color"])}"/>'
        parts = re.split("([\t\n])", _XML_REFUSES.sub("", r.get("text") or ""))
        text = "".join("<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{e(x, quote=False)}</w:t>' for x in parts if x)
        return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}{text}</w:r>'

    media: list[tuple[str, bytes]] = []
    body = []
    for k, (level, runs, *align) in enumerate(paragraphs):
        props = (f'<w:pStyle w:val="Heading{level}"/>' if level else "") + (f'<w:jc w:val="{e(align[0])}"/>' if align and align[0] else "")
        shown = "".join(map(run, runs))
        for name, data in (pictures or {}).get(k, ()):
            media.append((f"image{len(media) + 1}.{name.rpartition('.')[2].lower() or 'png'}", data))
            shown += f'<w:r><w:drawing><wp:inline><a:graphic><a:graphicData uri="{_PICTURE}"><pic:pic><pic:blipFill><a:blip r:embed="rImg{len(media)}"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        body.append(f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{shown}</w:p>')
    kinds = "".join(f'<Default Extension="{x}" ContentType="{T.MEDIA_TYPES.get(x, "application/octet-stream")}"/>' for x in sorted({n.rpartition(".")[2] for n, _ in media}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_RELATIONS}"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="utf-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:pic="{_PICTURE}"><w:body>{"".join(body)}</w:body></w:document>')
        if media:
            z.writestr("word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_RELATIONS}">' + "".join(f'<Relationship Id="rImg{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/{n}"/>' for k, (n, _) in enumerate(media, 1)) + "</Relationships>")
            for n, data in media:
                z.writestr(f"word/media/{n}", data)
    return out.getvalue()


_PICTURE = "http://schemas.openxmlformats.org/drawingml/2006/picture"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Characters that XML cannot hold.
_XML_REFUSES = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def docx_files(paragraphs: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): one DOCX a book from (doc_id, pos, heading_level, runs) and pictures (doc_id, pos, k, name, content)."""
    rows = paragraphs.select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("heading_level").cast("int").alias("heading_level"), "runs", F.lit(-1).alias("k"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("content"))
    if pictures is not None:
        rows = rows.unionByName(pictures.select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("k").cast("int").alias("k"), "name", "content"), allowMissingColumns=True)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        book, images, number = [], {}, {}
        for r in sorted(batch.to_dict("records"), key=lambda r: (r["pos"], r["k"])):
            if r["k"] < 0:
                number[r["pos"]] = len(book)
                level = r["heading_level"]
                book.append((int(level) if level is not None and level == level else None, [x for x in (r["runs"] if r["runs"] is not None else [])]))
            elif r["pos"] in number:
                images.setdefault(number[r["pos"]], []).append((r["name"], bytes(r["content"])))
        return pd.DataFrame({"doc_id": [batch["doc_id"].iloc[0]], "content": [docx_bytes(book, images)]})

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id string, content binary")


def epub_files(pages: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): one EPUB a book from chapter_pages, with further members (doc_id, name, content)."""
    rows = pages.select("doc_id", F.col("chapter_no").cast("int").alias("chapter_no"), "title", "page", F.lit(None).cast("binary").alias("data"))
    if extra is not None:
        rows = rows.unionByName(extra.select("doc_id", F.col("name").alias("title"), F.col("content").alias("data")), allowMissingColumns=True)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        more = batch[batch["data"].notna()]
        own = batch[batch["data"].isna()]
        chapters = sorted((int(n), t, p) for n, t, p in zip(own["chapter_no"], own["title"], own["page"]))
        return pd.DataFrame({"doc_id": [batch["doc_id"].iloc[0]], "content": [epub_bytes(batch["doc_id"].iloc[0], chapters, {n: bytes(x) for n, x in zip(more["title"], more["data"])})]})

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id string, content binary")


def rebuilt_epubs(files: DataFrame, paragraphs: DataFrame, titles: DataFrame, language: str = "id") -> DataFrame:
    """(doc_id, content): source EPUBs (doc_id, content) with their text replaced and all else kept.

    paragraphs (doc_id, pos, heading_level, runs) has the new runs of the paragraphs that change, by their place in the book; titles
    (doc_id, href, title) the new labels of the navigation, an empty href being the book's own title. Stylesheets, pictures, other
    members and attributes of pages stay; language marks and the labels of the navigation document and the NCX change. The mimetype comes first, stored.
    """
    body = F.array_join(F.transform("runs", run_markup), "")
    new = paragraphs.select("doc_id", F.struct(F.col("pos").cast("int").alias("pos"), body.alias("markup")).alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("new"))
    label = titles.select("doc_id", F.struct("href", "title").alias("t")).groupBy("doc_id").agg(F.collect_list("t").alias("titles"))
    rows = files.select("doc_id", "content").join(new, "doc_id", "left").join(label, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, data, new_, titles_ in zip(b["doc_id"], b["content"], b["new"], b["titles"]):
                markup = {x["pos"]: x["markup"] for x in (new_ if new_ is not None else [])}
                named = {x["href"]: x["title"] for x in (titles_ if titles_ is not None else [])}
                out.append((doc, _rebuilt(bytes(data), markup, named, language)))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    return rows.mapInPandas(run, "doc_id string, content binary")


_LANG = re.compile(r"""((?:xml:)?lang=)(["'])en(?:-[A-Za-z]+)?\2""")


def _rebuilt(data: bytes, markup: dict[int, str], titles: dict[str, str], language: str) -> bytes:
    book = Epub(data)
    pages: dict[str, str] = {}
    pos = 0
    for idref, _ in book.spine:
        page = book.page(idref)
        if page is None:
            continue
        n = len(page_blocks(page).out)
        pages[book.manifest[idref]["path"]] = _LANG.sub(rf"\1\2{language}\2", replace_blocks(page, [markup.get(pos + k) for k in range(n)]))
        pos += n
    # labels by whole link, else by link without its fragment, relative to the member that has them
    def labelled(text: str, at: str, pattern: str) -> str:
        def put(m: re.Match) -> str:
            whole = join_path(posixpath.dirname(at), m["href"])
            fragment = m["href"].partition("#")[2]
            got = titles.get(f"{whole}#{fragment}") if fragment else None
            got = titles.get(whole) if got is None else got
            return m.group() if got is None else m.group().replace(f">{m['label']}<", f">{html.escape(got, quote=False)}<", 1)

        return re.sub(pattern, put, text, flags=re.S)

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        written = {"mimetype"}
        for info in book.zip.infolist():
            name = info.filename
            if name in written:
                continue
            written.add(name)
            item = next((m for m in book.manifest.values() if m["path"] == name), {})
            content: bytes | str = book.zip.read(name)
            if "nav" in item.get("properties", "").split():
                text = pages.get(name) or content.decode("utf-8", "replace")
                content = _LANG.sub(rf"\1\2{language}\2", labelled(text, name, r'<a\b[^>]*href="(?P<href>[^"]*)"[^>]*>(?P<label>[^<]*)</a>'))
            elif name in pages:
                content = pages[name]
            elif item.get("media_type") == "application/x-dtbncx+xml":
                content = labelled(content.decode("utf-8", "replace"), name, r'<text>(?P<label>[^<]*)</text>\s*</navLabel>\s*<content\b[^>]*src="(?P<href>[^"]*)"')
            elif name == book.opf_path:
                text = re.sub(r"(<dc:language[^>]*>)[^<]*", rf"\g<1>{language}", content.decode("utf-8", "replace"), count=1)
                content = re.sub(r"(<dc:title[^>]*>)[^<]*", lambda m: m[1] + html.escape(titles[""], quote=False), text, count=1) if "" in titles else text
            z.writestr(name, content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_files(files: DataFrame, folder: str, suffix: str) -> int:
    """Writes (doc_id, content) as files of a folder all executors share, a path or a URI; each appears whole, under its name, at once."""
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for doc, data in zip(b["doc_id"], b["content"]):
                name = posixpath.join(root, f"{doc}.{suffix}")
                part = f"{name}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(data.encode() if isinstance(data, str) else bytes(data))
                fs.move(part, name)
            yield pd.DataFrame({"n": [len(b)]})

    return files.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def progress_files(states: DataFrame) -> DataFrame:
    """(doc_id, content): one JSON progress file a chapter from (chapter_id, chunk_id, status, translation, paragraph_translations, attempts,
    qa_passed, flagged, cache_hit), a row a chunk; done and flagged chunks are listed beside."""
    c = F.struct("translation", "paragraph_translations", "attempts", "qa_passed", "flagged", "cache_hit")
    per = states.groupBy("chapter_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", c.alias("c"))))).alias("chunks"), F.min(F.col("status") == "completed").alias("all_done"),
        F.array_sort(F.collect_set(F.when(F.col("qa_passed"), F.col("chunk_id")))).alias("completed_chunks"), F.array_sort(F.collect_set(F.when(F.col("flagged"), F.col("chunk_id")))).alias("flagged_chunks"))
    x = F.struct("chapter_id", F.when(F.col("all_done"), "completed").otherwise("in_progress").alias("status"), "chunks", "completed_chunks", "flagged_chunks")
    return per.select(F.col("chapter_id").alias("doc_id"), F.to_json(x).alias("content"))


def save_progress(states: DataFrame, folder: str) -> int:
    """Writes progress files; what a file held before stays beside it as `.json.bak`."""
    spark = states.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    files = progress_files(states)
    if fs.exists(root):
        old = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("doc_id"), "content")
        write_files(old.join(files.select("doc_id"), "doc_id", "left_semi"), folder, "json.bak")
    return write_files(files, folder, "json")


def entity_files(entities: DataFrame, name: str = "entities", version: int = 3) -> DataFrame:
    """(doc_id, content): an entity file, with characters and proper nouns by canonical name; of records that share one the least id counts.
    An entity file is one document of the size of a project's names."""
    from foliant.operators.entities import category, normal_type

    record = F.struct("canonical_name", "entity_type", "translation", "aliases", "locked", "source", "notes", "research_failed", "research")
    first = entities.where("canonical_name is not null").groupBy(F.col("canonical_name").alias("k"), category(normal_type(F.col("entity_type"))).alias("cat")).agg(F.min_by(record, "entity_id").alias("r"))
    pick = lambda c: F.map_from_entries(F.collect_list(F.when(F.col("cat") == c, F.struct("k", "r"))))
    return first.agg(pick("characters").alias("characters"), pick("proper_nouns").alias("proper_nouns")).select(
        F.lit(name).alias("doc_id"), F.to_json(F.struct(F.lit(version).alias("version"), "characters", "proper_nouns")).alias("content"))


def cache_files(cache: DataFrame) -> DataFrame:
    """(doc_id, content): a JSON file a cache entry, named by its key."""
    cols = [c for c in ("key", "cache_version", "status", "translation", "paragraph_translations") if c in cache.columns]
    return cache.select(F.col("key").alias("doc_id"), F.to_json(F.struct(*cols)).alias("content"))


def save_stats(stats: DataFrame, folder: str) -> None:
    """Statistics as JSON lines, replaced as a whole."""
    stats.write.mode("overwrite").json(folder)


def chapter_files(pages: DataFrame) -> DataFrame:
    """(doc_id, content): an EPUB of its own for each chapter of chapter_pages, named `book-chapter_no-title`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["name"], "content": [epub_bytes(f"{d} {n}", [(int(n), t, p)]) for d, n, t, p in zip(b["doc_id"], b["chapter_no"], b["title"], b["page"])]})

    name = F.concat_ws("-", T.safe_title("doc_id"), F.format_string("%04d", F.col("chapter_no").cast("int")), F.substring(T.safe_title(F.coalesce("title", F.lit(""))), 1, 60))
    return pages.select("doc_id", "chapter_no", "title", "page", name.alias("name")).mapInPandas(run, "doc_id string, content binary")


def glossary_text(lines: DataFrame) -> str:
    """A glossary file from (section, line_no, term, meaning): sections under `##`, entries in order. A glossary is a driver-side file."""
    extra = [c for c in ("active", "is_alias") if c in lines.columns]
    rows = lines.select("section", "line_no", "term", "meaning", *extra).orderBy(F.col("section").asc_nulls_first(), "line_no").toLocalIterator()
    out, now = [], object()
    for r in rows:
        if r["section"] != now:
            now = r["section"]
            out += ["", f"## {now}"] if now else []
        mark = ("# " if extra and r["active"] is False else "") + ("~" if "is_alias" in extra and r["is_alias"] else "")
        out.append(f"{mark}{r['term']} = {r['meaning'] or ''}")
    return "\n".join(out).strip() + "\n"


def write_versioned(df: DataFrame, folder: str, version: int, keep: int = 5) -> str:
    """A new version of a state table beside the last ones; readers take the newest whole one, and only `keep` stay."""
    path = f"{folder.rstrip('/')}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    have = sorted((s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v")), key=lambda p: p.getName())
    for old in have[: max(0, len(have) - keep)]:
        fs.delete(old, True)
    return path


def newest_version(spark, folder: str) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(p.toString() for p in whole))


def backup_outputs(spark, folder: str, suffix: str, retention: int = 5) -> int:
    """Copies the output files of a folder into its backups, named by time, and keeps the newest `retention` of each (0: none).

    Nothing happens without output. Files are copied one after the other; a folder has one a book.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root, to = path(folder), path(folder, ".backups")
    fs = root.getFileSystem(conf)
    n = 0
    for f in fs.listStatus(root) if fs.exists(root) else ():
        name = f.getPath().getName()
        if f.isFile() and name.endswith(f".{suffix}"):
            fs.mkdirs(to)
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, f.getPath(), fs, path(to, f"{name[: -len(suffix) - 1]}.{time.time_ns():020d}.{suffix}"), False, conf)
            n += 1
    held: dict[str, list] = {}
    for f in fs.listStatus(to) if fs.exists(to) else ():
        name = f.getPath().getName()
        if name.endswith(f".{suffix}"):
            held.setdefault(name[: -len(suffix) - 22], []).append(f.getPath())
    for old in held.values():
        for p in sorted(old, key=lambda x: x.getName(), reverse=True)[retention:]:
            fs.delete(p, False)
    return n


def save_selection(numbers: DataFrame, folder: str, project: str) -> int:
    """The chosen chapter numbers of a project as a JSON file `{"chapters": [1, 2]}`, sorted, once each."""
    one = numbers.agg(F.to_json(F.struct(F.array_sort(F.collect_set(F.col(numbers.columns[0]).cast("int"))).alias("chapters"))).alias("content"))
    return write_files(one.select(F.lit(project).alias("doc_id"), "content"), folder, "json")
