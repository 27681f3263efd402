"""Round trips: tables written as books and state files into the shared folder and read back, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import navigation, progress, qa, structure
from foliant.plans.sql import _P, _strip
from foliant.plans.sql import SQL as _CORE
from foliant.session import shared_folder, ship_package, table
from foliant.sinks import books
from foliant.sources import archives, state

#: Positions of a book that make a chapter of the written books.
CHAPTER = 50
#: White space of any kind and characters that files cannot hold; texts are compared without them, as markup folds white space.
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{00}-\x{1F}]"
PNG = b"\x89PNG\r\n\x1a\n"


def _solid(c) -> F.Column:
    return F.regexp_replace(c, _BLANK, "")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs once each; a null run has no text."""
    p = table(spark, sf, "paragraphs").select("doc_id", F.col("pos").cast("int").alias("pos"), "heading_level", F.coalesce("runs", F.array().cast(table(spark, sf, "paragraphs").schema["runs"].dataType)).alias("runs"))
    p = p.groupBy("doc_id", "pos").agg(F.max(F.struct("heading_level", F.to_json("runs").alias("j"))).alias("m"), F.first("runs").alias("runs"))
    return p.select("doc_id", "pos", F.col("m.heading_level").alias("heading_level"), "runs", F.floor(F.col("pos") / CHAPTER).cast("int").alias("chapter_no"), F.concat(F.lit("Part "), F.floor(F.col("pos") / CHAPTER).cast("string")).alias("title"))


def _books(spark: SparkSession, sf: str) -> str:
    """A folder with an EPUB a novel, each with a stylesheet, two pictures of which one is used, an NCX and a plain member."""
    ship_package(spark)
    pages = books.chapter_pages(_rows(spark, sf))
    look = F.lit('<link rel="stylesheet" href="css/a.css"/></head>')
    pages = pages.withColumn("page", F.concat(F.replace("page", F.lit("</head>"), look)))
    ncx = F.concat(F.lit('<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="n0"><navLabel><text>Old</text></navLabel><content src="c0000.xhtml"/></navPoint></navMap></ncx>'), F.lit(""))
    docs = pages.select("doc_id").distinct()
    extra = [docs.select("doc_id", F.lit(n).alias("name"), c.cast("binary").alias("content")) for n, c in (("OEBPS/css/a.css", F.concat(F.lit("p{} /*"), F.col("doc_id"), F.lit("*/"))), ("OEBPS/toc.ncx", ncx), ("OEBPS/img/used.png", F.lit(PNG)), ("OEBPS/img/other.png", F.lit(PNG)))]
    more = extra[0]
    for e in extra[1:]:
        more = more.unionByName(e)
    folder = shared_folder(spark, "books")
    books.write_files(books.epub_files(pages, more), folder, "epub")
    return folder


def _shape(p: DataFrame) -> DataFrame:
    """Paragraphs by what markup keeps of them."""
    size = lambda k: F.aggregate(F.filter("runs", lambda r: F.coalesce(r["formatting"][k], F.lit(False))), F.lit(0), lambda n, r: n + F.length(_solid(F.coalesce(r["text"], F.lit("")))))
    text = F.array_join(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return p.select("doc_id", "pos", "heading_level", F.md5(_solid(text)).alias("text_md5"), size("bold").alias("bold"), size("italic").alias("italic"), size("superscript").alias("raised"))


def q50_epub_paragraphs(spark, sf):
    return _shape(archives.read_paragraphs(spark, f"{_books(spark, sf)}/*.epub"))


def q51_epub_structure(spark, sf):
    folder = _books(spark, sf)
    spine = structure.without_navigation(archives.read_spine(spark, f"{folder}/*.epub"), archives.read_manifest(spark, f"{folder}/*.epub"))
    return spine.join(archives.read_manifest(spark, f"{folder}/*.epub").withColumnRenamed("item_id", "idref"), ["doc_id", "idref"]).select("doc_id", "pos", "idref", "path", "media_type")


def q52_epub_members(spark, sf):
    return archives.read_members(spark, f"{_books(spark, sf)}/*.epub").groupBy("doc_id").agg(
        F.count("*").cast("int").alias("members"), F.min_by("name", "pos").alias("first"), F.count_if("stored").cast("int").alias("stored"), F.count_if(F.col("name").endswith(".xhtml")).cast("int").alias("pages"))


def q53_archive_faults(spark, sf):
    folder = f"{_books(spark, sf)}/*.epub"
    # a book loses the pages whose number its name says, and sound books have no faults
    lost = F.regexp_extract("name", r"c0*(\d+)\.xhtml$", 1).try_cast("int") == F.length("doc_id") % 5
    faults = qa.archive_issues(archives.read_members(spark, folder).where(~F.coalesce(lost, F.lit(False))), archives.read_manifest(spark, folder), archives.read_spine(spark, folder))
    every = archives.read_members(spark, folder).select("doc_id").distinct()
    return qa.archives_passed(every, faults).join(faults.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "rule", "message"))), ";").alias("faults")), "doc_id", "left").select("doc_id", "passed", "faults")


def q54_epub_metadata(spark, sf):
    return archives.read_metadata(spark, f"{_books(spark, sf)}/*.epub").select("doc_id", "opf_path", "version", "name", "value")


def q55_docx_paragraphs(spark, sf):
    ship_package(spark)
    folder = shared_folder(spark, "docx")
    books.write_files(books.docx_files(_rows(spark, sf)), folder, "docx")
    return _shape(archives.read_paragraphs(spark, f"{folder}/*.docx"))


def q56_docx_pictures(spark, sf):
    ship_package(spark)
    p = _rows(spark, sf)
    pictures = p.where("pos % 40 = 3").select("doc_id", "pos", F.lit(0).alias("k"), F.lit("x.png").alias("name"), F.concat(F.lit("PNG "), F.col("doc_id"), F.lit(" "), F.col("pos").cast("string")).cast("binary").alias("content"))
    folder = shared_folder(spark, "pictures")
    books.write_files(books.docx_files(p, pictures), folder, "docx")
    return archives.read_pictures(spark, f"{folder}/*.docx").select("doc_id", "pos", "k", F.md5("content").alias("content_md5"))


def _rebuilt(spark, sf):
    folder = _books(spark, sf)
    files = spark.read.format("binaryFile").load(f"{folder}/*.epub").select(F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("doc_id"), "content")
    p = table(spark, sf, "paragraphs").groupBy("doc_id", F.col("pos").cast("int").alias("pos")).agg(F.max("paragraph_id").alias("paragraph_id"))
    place = p.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    t = table(spark, sf, "assembled_paragraphs").where("translated_text is not null").groupBy("paragraph_id").agg(F.max("translated_text").alias("t"))
    kind = table(spark, sf, "paragraphs").schema["runs"].dataType.elementType["formatting"].dataType
    new = place.join(t, "paragraph_id").select("doc_id", F.col("at").alias("pos"), F.lit(None).cast("int").alias("heading_level"), F.array(F.struct(F.col("t").alias("text"), F.lit(None).cast(kind).alias("formatting"))).alias("runs"))
    titles = files.select("doc_id").withColumn("x", F.explode(F.array(F.struct(F.lit("").alias("href"), F.concat(F.lit("Novel "), F.col("doc_id")).alias("title")), F.struct(F.lit("OEBPS/c0000.xhtml").alias("href"), F.lit("Bagian & awal").alias("title"))))).select("doc_id", "x.href", "x.title")
    out = shared_folder(spark, "rebuilt")
    books.write_files(books.rebuilt_epubs(files, new, titles), out, "epub")
    return folder, out


def q57_rebuilt_epub(spark, sf):
    _, out = _rebuilt(spark, sf)
    return archives.read_paragraphs(spark, f"{out}/*.epub").select("doc_id", "pos", "heading_level", F.md5(_solid(F.coalesce("text", F.lit("")))).alias("text_md5"))


def q58_rebuilt_members(spark, sf):
    source, out = _rebuilt(spark, sf)
    a = archives.read_members(spark, f"{source}/*.epub").select("doc_id", "name", F.md5("content").alias("before"))
    b = archives.read_members(spark, f"{out}/*.epub").select("doc_id", "name", F.md5("content").alias("after"), F.col("content").cast("string").alias("t"))
    rows = a.join(b, ["doc_id", "name"], "full_outer").where(~F.col("name").rlike(r"c\d+\.xhtml$"))
    label = F.coalesce(F.nullif(F.regexp_extract("t", r"<text>([^<]*)</text>", 1), F.lit("")), F.nullif(F.regexp_extract("t", r"<dc:title>([^<]*)<", 1), F.lit("")), F.nullif(F.regexp_extract("t", r'href="c0000.xhtml">([^<]*)<', 1), F.lit("")))
    return rows.select("doc_id", "name", F.coalesce(F.col("before") == F.col("after"), F.lit(False)).alias("same"), label.alias("label"))


def q59_navigation_labels(spark, sf):
    p = structure.distinct_paragraphs(table(spark, sf, "paragraphs")).where("idref is not null").select("doc_id", F.col("idref").alias("href"), "pos", "heading_level", "text")
    named = p.where("heading_level = 1").groupBy("doc_id", "href").agg(F.min("text").alias("title")).where("length(title) % 2 = 0")
    titles = navigation.titles_by_href(named, p)
    points = p.groupBy("doc_id", "href").agg(F.min("pos").alias("pos")).select("doc_id", "pos", F.concat("href", F.when(F.col("pos") % 2 == 0, "#f").otherwise("")).alias("href"), F.lit("old").alias("label"))
    return navigation.updated_labels(points, titles)


def q60_book_parts(spark, sf):
    folder = f"{_books(spark, sf)}/*.epub"
    manifest, spine = archives.read_manifest(spark, folder), archives.read_spine(spark, folder)
    part, pages = navigation.book_part(spine.where("pos % 2 = 1").select("doc_id", "idref"), manifest, spine)
    return part.select("doc_id", F.lit("manifest").alias("kind"), F.col("item_id").alias("id")).unionByName(pages.select("doc_id", F.lit("spine").alias("kind"), F.col("idref").alias("id")))


def q61_referenced_media(spark, sf):
    folder = f"{_books(spark, sf)}/*.epub"
    pages = archives.read_pages(spark, folder).withColumn("html", F.when(F.col("pos") == 0, F.replace("html", F.lit("</body>"), F.lit('<img src="img/used.png"/></body>'))).otherwise(F.col("html")))
    media = archives.read_members(spark, folder).where(F.col("name").endswith(".png")).select("doc_id", "name")
    return navigation.referenced_media(media, pages)


def q62_stylesheets(spark, sf):
    return archives.read_pages(spark, f"{_books(spark, sf)}/*.epub").select("doc_id", "pos", F.array_join("stylesheets", ",").alias("sheets"))


def q63_refused_archives(spark, sf):
    folder = _books(spark, sf)
    whole = spark.read.format("binaryFile").load(f"{folder}/*.epub").select(F.concat(F.lit("cut-"), F.regexp_extract("path", r"([^/]+)\.epub$", 1)).alias("doc_id"), F.substring("content", 1, 300).alias("content"))
    books.write_files(whole, folder, "epub")
    return archives.read_refused(spark, folder).select("doc_id", "suffix")


def _glossary_file(spark, sf) -> tuple[str, DataFrame]:
    g = table(spark, sf, "glossary")
    lines = g.select("line_no", F.coalesce("section", F.lit("lainnya")).alias("section"), T.strip(T.collapse("term")).alias("term"), T.strip(T.collapse(F.coalesce("meaning", F.lit("")))).alias("meaning"), "active", "is_alias").where("term <> '' and not term rlike '[=.:#~]'")
    folder = shared_folder(spark, "glossary")
    books.write_files(spark.createDataFrame([("g", books.glossary_text(lines))], "doc_id string, content string"), folder, "txt")
    return folder, lines


def q64_glossary_file(spark, sf):
    ship_package(spark)
    folder, _ = _glossary_file(spark, sf)
    return state.read_glossary(spark, folder).select("section", "term", "meaning", "active", "is_alias")


def q65_active_terms(spark, sf):
    ship_package(spark)
    folder, _ = _glossary_file(spark, sf)
    return state.active_terms(state.read_glossary(spark, folder)).groupBy("term", "meaning").agg(F.count("*").alias("n"))


def q66_edited_glossary(spark, sf):
    g = table(spark, sf, "glossary").groupBy("line_no").agg(F.max(F.struct(F.coalesce("section", F.lit("x")).alias("section"), "term", F.coalesce("meaning", F.lit("")).alias("meaning"), "active", "is_alias")).alias("g")).select("line_no", "g.*")
    edits = g.where("line_no % 10 = 0").select("line_no", F.when(F.col("line_no") % 20 == 0, "").otherwise(F.concat("term", F.lit("!"))).alias("term"), F.lit("m").alias("meaning"), F.lit(True).alias("active"))
    new = table(spark, sf, "region").select(F.lit(None).cast(edits.schema["line_no"].dataType).alias("line_no"), F.col("r_name").alias("term"), F.lit("").alias("meaning"), F.lit(False).alias("active"))
    return state.edited(g, edits.unionByName(new)).select("section", "line_no", "term", "meaning", "active")


def _states(spark, sf) -> DataFrame:
    p = table(spark, sf, "processed_chunks").groupBy("chapter_id", "chunk_id").agg(F.max(F.struct(F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("qa_passed", F.lit(False)).alias("qa_passed"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))).alias("s"))
    return p.where("chapter_id is not null and chunk_id is not null").select("chapter_id", "chunk_id", F.when(F.col("s.qa_passed"), "completed").otherwise("in_progress").alias("status"), "s.*", F.array("s.translation").alias("paragraph_translations"))


def q67_progress_files(spark, sf):
    """Every third chapter is saved twice and its newer file then damaged, so its backup counts."""
    ship_package(spark)
    rows, folder = _states(spark, sf), shared_folder(spark, "progress")
    books.save_progress(rows, folder)
    third = rows.where(F.length("chapter_id") + F.ascii(F.right("chapter_id", F.lit(1))) % 3 == F.length("chapter_id"))
    books.save_progress(third.withColumn("translation", F.lit("new")), folder)
    books.write_files(third.select(F.col("chapter_id").alias("doc_id")).distinct().withColumn("content", F.lit("{broken")), folder, "json")
    return state.read_progress_tolerant(spark, folder).select("chapter_id", "chunk_id", "status", F.md5("translation").alias("text_md5"), "attempts", "qa_passed", "flagged")


def q68_entity_file(spark, sf):
    ship_package(spark)
    folder = shared_folder(spark, "entities")
    books.write_files(books.entity_files(table(spark, sf, "entities")), folder, "json")
    return state.read_entities(spark, folder).select("canonical_name", "entity_type", "translation", F.coalesce(F.array_join("aliases", "|", "~"), F.lit("")).alias("aliases"), "locked", "research_failed", F.size("research").alias("n_research"))


def q69_cache_files(spark, sf):
    ship_package(spark)
    rows = _states(spark, sf)
    cache = rows.select(F.sha2(F.concat_ws("/", "chapter_id", "chunk_id"), 256).alias("key"), F.when(F.col("attempts") > 2, 2).otherwise(1).alias("cache_version"), F.when(F.col("qa_passed"), "passed").otherwise("failed").alias("status"), "translation")
    folder = shared_folder(spark, "cache")
    books.write_files(books.cache_files(cache), folder, "json")
    return state.read_cache(spark, folder).select("key", F.md5("translation").alias("text_md5"))


def q93_job_log(spark, sf):
    """A log with a header a chapter and a line a chunk, of which those of flagged chunks warn."""
    ship_package(spark)
    rows = _states(spark, sf).select("chapter_id", "chunk_id", "flagged")
    line = F.concat(F.when(F.col("flagged"), "  WARNING ").otherwise("  ok "), "chunk_id")
    text = rows.groupBy("chapter_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("chunk_id", F.lit("\x01"), line))), "\n").alias("t"))
    body = F.regexp_replace("t", "[^\n]*\x01", "")
    folder = shared_folder(spark, "log")
    books.write_files(text.select(F.col("chapter_id").alias("doc_id"), F.concat(F.lit("[1/1] Chapter: "), "chapter_id", F.lit("\n"), body).alias("content")), folder, "log")
    lines = state.read_lines(spark, folder)
    # the logs of all chapters follow each other as one
    files = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    from foliant.operators.prefix import running_total

    number = files.withColumn("k", F.regexp_extract("file", r"nv0*(\d+)_", 1).cast("bigint") * 10_000 + F.regexp_extract("file", r"chapter_0*(\d+)", 1).cast("bigint"))
    before = running_total(number.withColumn("g", F.lit(0)), ["g"], "k", F.col("n"), "upto").select("file", (F.col("upto") - F.col("n")).alias("before"))
    one = lines.join(before, "file").select((F.col("before") + F.col("line_no")).alias("line_no"), "line")
    return progress.failure_reasons(one)


def q94_usage_files(spark, sf):
    ship_package(spark)
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n")).where("day is not null")
    per = e.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("day", F.create_map("event_type", "n"))))).alias("content"))
    folder = shared_folder(spark, "usage")
    books.write_files(per.select(F.col("event_type").alias("doc_id"), "content"), folder, "json")
    return state.read_usage(spark, folder)


def q95_title_files(spark, sf):
    ship_package(spark)
    heads = structure.distinct_paragraphs(table(spark, sf, "paragraphs")).where("heading_level is not null and text <> ''").select("doc_id", F.col("text").alias("title")).distinct()
    per = heads.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("title", F.concat("title", F.lit("!")))))).alias("content"))
    folder = shared_folder(spark, "titles")
    books.write_files(per, folder, "json")
    return state.read_titles(spark, folder).withColumnRenamed("file", "doc_id")


def q96_listings(spark, sf):
    ship_package(spark)
    folder = shared_folder(spark, "listing")
    names = table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit("x").alias("content"))
    parts = []
    for k, (sub, suffix, cond) in enumerate((("a", "epub", "n_nationkey % 2 = 0"), ("b", "docx", "true"), ("b", "log", "n_nationkey % 3 = 0"), ("b", "epub", "n_nationkey % 5 < 2"))):
        books.write_files(names.where(cond).select(F.col("n_name").alias("doc_id"), F.repeat("content", F.lit(k + 1)).alias("content")), f"{folder}/{sub}", suffix)
    for sub in ("a", "b"):
        parts.append(state.listing(spark, f"{folder}/{sub}", ("epub", "docx")))
    return state.first_of(*parts).select("name", "size", F.regexp_extract("path", r"/([ab])/[^/]+$", 1).alias("folder"))


def q97_tail_of_logs(spark, sf):
    ship_package(spark)
    folder = shared_folder(spark, "tails")
    t = table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("doc_id"), F.regexp_replace("text", r"\r\n?", "\n").alias("content"))
    books.write_files(t, folder, "log")
    got = state.tail(state.read_lines(spark, folder), 3)
    return got.select(F.regexp_extract("file", r"([^/]+)\.log$", 1).cast("bigint").alias("doc_id"), "line_no", F.md5("line").alias("line_md5"))


def q98_versioned_state(spark, sf):
    folder = shared_folder(spark, "state")
    rows = progress.latest_state(table(spark, sf, "progress")).select("chapter_id", "chunk_id", "status")
    for v in range(4):
        books.write_versioned(rows.withColumn("v", F.lit(v)), folder, v, keep=2)
    return books.newest_version(spark, folder).groupBy("v", "status").agg(F.count("*").alias("n"))


def q99_exported_chapters(spark, sf):
    ship_package(spark)
    pages = books.chapter_pages(_rows(spark, sf).withColumn("title", F.concat(F.lit("A/B: "), F.col("chapter_no").cast("string"))))
    folder = shared_folder(spark, "chapters")
    books.write_files(books.chapter_files(pages), folder, "epub")
    return archives.read_paragraphs(spark, f"{folder}/*.epub").groupBy("doc_id").agg(F.count("*").alias("n"))


def q99_saved_stats(spark, sf):
    from foliant.operators import stats

    folder = shared_folder(spark, "stats")
    got = stats.chapter_stats(table(spark, sf, "processed_chunks"))
    books.save_stats(got, folder)
    return spark.read.schema(got.schema).json(folder)


def q99_output_backups(spark, sf):
    """Four versions of each output, of which the backups keep two."""
    ship_package(spark)
    folder = shared_folder(spark, "outputs")
    names = table(spark, sf, "nation").select(F.col("n_name").alias("doc_id"), "n_nationkey")
    for v in range(4):
        books.write_files(names.where(F.col("n_nationkey") % 4 >= v).select("doc_id", F.lit(f"v{v}").alias("content")), folder, "txt")
        books.backup_outputs(spark, folder, "txt", retention=2)
    kept = state.read_lines(spark, f"{folder}/.backups/*.txt")
    return kept.groupBy(F.regexp_extract("file", r"([^/]+)\.\d{20}\.txt$", 1).alias("name")).agg(F.array_join(F.sort_array(F.collect_list("line")), ",").alias("versions"))


def q99_selection(spark, sf):
    ship_package(spark)
    folder = shared_folder(spark, "selection")
    books.save_selection(table(spark, sf, "chunks").select(F.regexp_extract("chapter_id", r"(\d+)$", 1).cast("int").alias("n")), folder, "p")
    return spark.read.schema("chapters array<int>").json(folder).select(F.explode("chapters").alias("chapter"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}

_SOLID = r"[\s\v\x{85}\p{Z}\x{00}-\x{1F}]+"
_ROWS = f"""r AS (SELECT doc_id, pos, max(heading_level) AS heading_level, any_value(coalesce(runs, [])) AS runs, CAST(floor(pos / {CHAPTER}.0) AS INTEGER) AS c FROM paragraphs GROUP BY doc_id, pos)"""


def _size(flag: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(list_filter(runs, lambda x: coalesce(x.formatting.{flag}, false)), lambda x: length(regexp_replace(coalesce(x.text, ''), '{_SOLID}', '', 'g')))), 0) AS INTEGER)"


_TEXT = f"regexp_replace(array_to_string(list_transform(runs, lambda x: coalesce(x.text, '')), ''), '{_SOLID}', '', 'g')"
_AT = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER)"
_SHAPE = f"SELECT doc_id, {_AT} AS pos, heading_level, md5({_TEXT}) AS text_md5, {_size('bold')} AS bold, {_size('italic')} AS italic, {_size('superscript')} AS raised"
_PARTS = f"{_ROWS}, k AS (SELECT DISTINCT doc_id, c, 'c' || lpad(CAST(c AS VARCHAR), 4, '0') AS id FROM r)"
_GLOSSARY = f"""l AS (SELECT line_no, coalesce(section, 'lainnya') AS section, {_strip("regexp_replace(term, '[\\s\\v\\x{85}\\p{Z}]+', ' ', 'g')")} AS term,
  {_strip("regexp_replace(coalesce(meaning, ''), '[\\s\\v\\x{85}\\p{Z}]+', ' ', 'g')")} AS meaning, active, is_alias FROM glossary),
g AS (SELECT * FROM l WHERE term <> '' AND NOT regexp_matches(term, '[=.:#~]'))"""
_SAVED = """s AS (SELECT chapter_id, chunk_id, max({'translation': coalesce(translation, ''), 'attempts': coalesce(attempts, 0), 'qa_passed': coalesce(qa_passed, false), 'flagged': coalesce(flagged, false), 'cache_hit': coalesce(cache_hit, false)}) AS x
  FROM processed_chunks WHERE chapter_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL)"""

SQL = {
    "q50_epub_paragraphs": f"WITH {_ROWS} {_SHAPE} FROM r",
    "q51_epub_structure": f"WITH {_PARTS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS INTEGER) AS pos, id AS idref, 'OEBPS/' || id || '.xhtml' AS path, 'application/xhtml+xml' AS media_type FROM k",
    "q52_epub_members": f"WITH {_PARTS} SELECT doc_id, CAST(count(*) + 8 AS INTEGER) AS members, 'mimetype' AS first, CAST(1 AS INTEGER) AS stored, CAST(count(*) + 1 AS INTEGER) AS pages FROM k GROUP BY doc_id",
    "q53_archive_faults": f"""
WITH {_PARTS}, f AS (SELECT doc_id, 'OPF_RESOURCE_EXISTS missing OEBPS/' || id || '.xhtml' AS x FROM k WHERE c = length(doc_id) % 5)
SELECT d.doc_id, f.x IS NULL AS passed, f.x AS faults FROM (SELECT DISTINCT doc_id FROM k) d LEFT JOIN f USING (doc_id)""",
    "q54_epub_metadata": f"WITH {_PARTS} SELECT DISTINCT doc_id, 'OEBPS/content.opf' AS opf_path, '3.0' AS version, m.n AS name, coalesce(m.v, doc_id) AS value FROM k, (VALUES ('identifier', NULL), ('title', NULL), ('language', 'id')) AS m(n, v)",
    "q55_docx_paragraphs": f"""
WITH {_ROWS}, h AS (SELECT doc_id, count(*) FILTER (heading_level = 1) >= 2 AS leveled FROM r GROUP BY doc_id), x AS (SELECT * FROM ({_SHAPE} FROM r))
SELECT doc_id, pos, CASE WHEN leveled AND heading_level = 1 THEN 1 END AS heading_level, text_md5, bold, italic, raised FROM x JOIN h USING (doc_id)""",
    "q56_docx_pictures": f"WITH {_ROWS}, x AS (SELECT doc_id, pos AS p, {_AT} AS place FROM r) SELECT doc_id, place AS pos, CAST(0 AS INTEGER) AS k, md5('PNG ' || doc_id || ' ' || p) AS content_md5 FROM x WHERE p % 40 = 3",
    "q57_rebuilt_epub": f"""
WITH {_ROWS}, i AS (SELECT doc_id, pos, max(paragraph_id) AS paragraph_id FROM paragraphs GROUP BY ALL), t AS (SELECT paragraph_id, max(translated_text) AS t FROM assembled_paragraphs WHERE translated_text IS NOT NULL GROUP BY 1)
SELECT doc_id, {_AT} AS pos, heading_level, md5(coalesce(regexp_replace(t, '{_SOLID}', '', 'g'), {_TEXT})) AS text_md5 FROM r JOIN i USING (doc_id, pos) LEFT JOIN t USING (paragraph_id)""",
    "q58_rebuilt_members": f"""
WITH {_PARTS}, d AS (SELECT doc_id, min(c) AS first FROM k GROUP BY doc_id),
m AS (SELECT * FROM (VALUES ('mimetype', true, NULL), ('META-INF/container.xml', true, NULL), ('OEBPS/css/a.css', true, NULL), ('OEBPS/img/used.png', true, NULL), ('OEBPS/img/other.png', true, NULL),
  ('OEBPS/content.opf', false, 'title'), ('OEBPS/nav.xhtml', false, 'nav'), ('OEBPS/toc.ncx', true, 'ncx')) AS v(name, same, kind))
SELECT doc_id, name, CASE WHEN kind = 'nav' THEN first > 0 ELSE same END AS same, CASE kind WHEN 'title' THEN 'Novel ' || doc_id WHEN 'nav' THEN CASE WHEN first = 0 THEN 'Bagian &amp; awal' END WHEN 'ncx' THEN 'Old' END AS label FROM d, m""",
    "q59_navigation_labels": f"""
WITH {_P}, q AS (SELECT doc_id, idref AS href, pos, heading_level, text, {_strip('text')} AS s FROM p WHERE idref IS NOT NULL),
n AS (SELECT doc_id, href, min(text) AS title FROM q WHERE heading_level = 1 GROUP BY ALL HAVING length(min(text)) % 2 = 0),
g AS (SELECT doc_id, href, min(pos) AS pos, arg_min(s, pos) FILTER (heading_level IS NOT NULL AND s <> '') AS h, arg_min(s, pos) FILTER (s <> '') AS o FROM q GROUP BY ALL)
SELECT doc_id, pos, href || CASE WHEN pos % 2 = 0 THEN '#f' ELSE '' END AS href, coalesce(n.title, h, o, 'old') AS label FROM g LEFT JOIN n USING (doc_id, href)""",
    "q60_book_parts": f"""
WITH {_PARTS}, o AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS n FROM k)
SELECT doc_id, kind, id FROM o, (VALUES ('manifest'), ('spine')) AS v(kind) WHERE n % 2 = 1 UNION ALL SELECT DISTINCT doc_id, 'manifest', 'nav' FROM k""",
    "q61_referenced_media": f"WITH {_PARTS} SELECT DISTINCT doc_id, 'OEBPS/img/used.png' AS name FROM k",
    "q62_stylesheets": f"WITH {_PARTS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS INTEGER) AS pos, 'OEBPS/css/a.css' AS sheets FROM k",
    "q63_refused_archives": "SELECT DISTINCT 'cut-' || doc_id AS doc_id, 'epub' AS suffix FROM paragraphs",
    "q64_glossary_file": f"WITH {_GLOSSARY} SELECT section, term, meaning, active, is_alias FROM g",
    "q65_active_terms": f"""
WITH {_GLOSSARY}, r AS (SELECT row_number() OVER (ORDER BY section NULLS FIRST, line_no) AS n, * FROM g WHERE active AND meaning <> ''),
t AS (SELECT lower(term) AS k, arg_max(meaning, n) AS m FROM r WHERE NOT is_alias GROUP BY 1),
x AS (SELECT term, meaning FROM r WHERE NOT is_alias UNION ALL SELECT term, m FROM r JOIN t ON lower(meaning) = k WHERE is_alias)
SELECT term, meaning, count(*) AS n FROM x GROUP BY ALL""",
    "q66_edited_glossary": """
WITH g AS (SELECT line_no, max({'section': coalesce(section, 'x'), 'term': term, 'meaning': coalesce(meaning, ''), 'active': active, 'is_alias': is_alias}) AS g FROM glossary GROUP BY line_no)
SELECT g.section AS section, CAST(line_no AS DOUBLE) AS line_no, CASE WHEN line_no % 10 = 0 THEN g.term || '!' ELSE g.term END AS term, CASE WHEN line_no % 10 = 0 THEN 'm' ELSE g.meaning END AS meaning, CASE WHEN line_no % 10 = 0 THEN true ELSE g.active END AS active
FROM g WHERE line_no % 20 <> 0 UNION ALL
SELECT 'tambahan', CAST((SELECT max(line_no) FROM glossary) + row_number() OVER (ORDER BY lower(r_name), r_name) AS DOUBLE), r_name, '', false FROM region WHERE trim(r_name) <> ''""",
    "q67_progress_files": f"""
WITH {_SAVED} SELECT chapter_id, chunk_id, CASE WHEN bool_and(x.qa_passed) OVER (PARTITION BY chapter_id) THEN 'completed' ELSE 'in_progress' END AS status, md5(x.translation) AS text_md5, x.attempts AS attempts, x.qa_passed AS qa_passed, x.flagged AS flagged FROM s""",
    "q68_entity_file": f"""
WITH e AS (SELECT *, CASE WHEN lower({_strip('entity_type')}) = 'character' THEN 'character' ELSE 'proper_noun' END AS cat FROM entities WHERE canonical_name IS NOT NULL),
f AS (SELECT canonical_name, cat, min(entity_id) AS entity_id FROM e GROUP BY ALL)
SELECT e.canonical_name, coalesce(entity_type, e.cat) AS entity_type, translation, coalesce(array_to_string(list_transform(aliases, lambda a: coalesce(a, '~')), '|'), '') AS aliases, coalesce(locked, false) AS locked, coalesce(research_failed, false) AS research_failed,
  CAST(coalesce(len(research), 0) AS INTEGER) AS n_research FROM f JOIN e USING (entity_id)""",
    "q69_cache_files": f"WITH {_SAVED} SELECT sha256(chapter_id || '/' || chunk_id) AS key, md5(x.translation) AS text_md5 FROM s WHERE x.attempts <= 2 AND x.qa_passed AND {_strip('x.translation')} <> ''",
    "q93_job_log": f"WITH {_SAVED} SELECT chapter_id AS chapter, 'WARNING ' || max(chunk_id) AS reason FROM s WHERE x.flagged GROUP BY chapter_id",
    "q94_usage_files": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "q95_title_files": f"WITH {_P} SELECT DISTINCT doc_id, text AS title, text || '!' AS translated FROM p WHERE heading_level IS NOT NULL AND text <> ''",
    "q96_listings": """
WITH f AS (SELECT n_name || '.epub' AS name, 1 AS size, 'a' AS folder, 0 AS k FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name || '.docx', 2, 'b', 1 FROM nation UNION ALL SELECT n_name || '.epub', 4, 'b', 1 FROM nation WHERE n_nationkey % 5 < 2)
SELECT name, CAST(arg_min(size, k) AS BIGINT) AS size, arg_min(folder, k) AS folder FROM f GROUP BY name""",
    "q97_tail_of_logs": r"""
WITH t AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n') AS l FROM documents WHERE length(text) > 0),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS most FROM t) SELECT doc_id, CAST(n AS INTEGER) AS line_no, md5(line) AS line_md5 FROM x WHERE n > most - 3""",
    "q98_versioned_state": f"WITH x AS ({_CORE['q08_latest_state']}) SELECT CAST(3 AS INTEGER) AS v, status, count(*) AS n FROM x GROUP BY status",
    "q99_exported_chapters": f"WITH {_ROWS} SELECT doc_id || '-' || lpad(CAST(c AS VARCHAR), 4, '0') || '-A B ' || c AS doc_id, count(*) AS n FROM r GROUP BY r.doc_id, c",
    "q99_output_backups": "SELECT replace(n_name, ' ', '%20') AS name, ['v0,v0', 'v1,v1', 'v2,v2', 'v2,v3'][n_nationkey % 4 + 1] AS versions FROM nation",
    "q99_selection": "SELECT DISTINCT CAST(regexp_extract(chapter_id, '(\\d+)$', 1) AS INTEGER) AS chapter FROM chunks",
    "q99_saved_stats": _CORE["q06_chapter_stats"],
}
