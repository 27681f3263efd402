"""Structure of documents: chapters by headings or spine, kinds of spine documents, titles, bounds and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.prefix import BLOCK, running_total

# Patterns that decide the kind of a document or title.
CHAPTER_MARKER = r"(?i)^\s*(chapter|chap\.|prologue|epilogue|appendix|part)\b"
CHAPTER_TITLE = r"(?i)^(Chapter|Extra Chapter)\b"
TOC_MARKERS = ("toc", "contents", "tableofcontents", "daftarisi")
TOC_TITLES = ("contents", "table of contents", "toc", "daftar isi", "isi", "daftar kandungan")
NON_STORY = r"(?i)\b(cover|sampul|title page|copyright|colou?r gallery|illustrations?|afterword|table of contents|contents|credits|map|about the author|translator'?s note|author'?s note|promo|bonus)\b"


def paragraph_rows(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the joined text of their runs where `text` is null; repeated rows stay."""
    joined = F.array_join(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return paragraphs.select("doc_id", "pos", "paragraph_id", "idref", "heading_level", "all_bold", F.coalesce("text", joined, F.lit("")).alias("text"))


def distinct_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """paragraph_rows once each; repeated rows are exact copies."""
    return paragraph_rows(paragraphs).distinct()


def split_by_headings(paragraphs: DataFrame, doc_title: Column | None = None) -> DataFrame:
    """Body paragraphs with their chapter: doc_id, chapter_no (dense, from 1), title, pos, paragraph_id, text.

    A heading opens a chapter; of headings without text between them the last one counts, and one without text after it makes no
    chapter. What stands before the first heading is a chapter with the document's title; without headings all is one chapter.
    """
    heading = F.col("heading_level").isNotNull()
    # chapters are found on positions and headings alone; the texts of the body meet them once
    slim = paragraphs.select("doc_id", "pos", heading.cast("int").alias("h"), F.when(heading, F.col("text")).alias("t")).distinct()
    marked = running_total(slim, ["doc_id"], "pos", F.col("h"), "group", BLOCK)  # positions of a book are dense
    heads = marked.where("h = 1").groupBy("doc_id", "group").agg(F.max_by("t", "pos").alias("title"))
    places = marked.where("h = 0").select("doc_id", "pos", "group")
    numbers = places.groupBy("doc_id", "group").agg(F.min("pos").alias("start")).select("doc_id", "group", F.row_number().over(Window.partitionBy("doc_id").orderBy("group")).alias("chapter_no"))
    named = numbers.join(heads, ["doc_id", "group"], "left").withColumn("title", F.coalesce("title", doc_title if doc_title is not None else F.col("doc_id")))
    body = paragraphs.where(~heading).select("doc_id", "pos", "paragraph_id", "text").distinct()
    placed = places.join(named, ["doc_id", "group"]).drop("group")
    return body.join(placed, ["doc_id", "pos"]).select("doc_id", "chapter_no", "title", "pos", "paragraph_id", "text")


def classify_spine(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idref, classification, confidence) of spine documents: front_matter, chapter or ambiguous.

    Front matter has neither heading nor chapter marker, at most 8 paragraphs and 500 characters, and all its text is bold.
    """
    filled = T.strip("text") != ""
    stats = paragraphs.where(F.col("idref").isNotNull()).groupBy("doc_id", "idref").agg(
        F.count("*").alias("n"), F.count_if(filled).alias("filled"), F.count_if(F.col("heading_level").isNotNull()).alias("headings"),
        F.count_if(T.strip("text").rlike(CHAPTER_MARKER)).alias("markers"),
        F.count_if(filled & ~F.coalesce(F.col("all_bold") & F.col("heading_level").isNull(), F.lit(False))).alias("plain"),
        F.sum(F.when(filled, F.length(T.strip("text")) + 1).otherwise(0)).alias("chars"))
    front = (F.col("headings") == 0) & (F.col("markers") == 0) & (F.col("n") <= 8) & (F.col("filled") > 0) & (F.col("plain") == 0) & (F.col("chars") - 1 <= 500)
    sure = (F.col("headings") > 0) | (F.col("markers") > 0)
    kind = F.when(front, "front_matter").when(sure | (F.col("n") > 8), "chapter").otherwise("ambiguous")
    confidence = F.when(front | sure, 0.95).when(F.col("n") > 8, 0.85).otherwise(0.5)
    return stats.select("doc_id", "idref", kind.alias("classification"), confidence.alias("confidence"))


def is_toc(title: Column, idref: Column) -> Column:
    marked = F.lit(False)
    for m in TOC_MARKERS:
        marked = marked | F.lower(T.strip(idref)).contains(m)
    return F.coalesce(T.normal_name(title).isin(*TOC_TITLES), F.lit(False)) | F.coalesce(marked, F.lit(False))


def split_by_spine(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, idref, title, n_paragraphs): chapters of a spine, dense over those that are neither front matter nor a
    table of contents; title: first heading, else first text that begins like a chapter's title, else first text cut at 60 characters."""
    first = lambda cond: F.min_by(F.when(cond, T.strip("text")), F.when(cond, F.col("pos")))
    filled = T.strip("text") != ""
    per = paragraphs.where(F.col("idref").isNotNull()).groupBy("doc_id", "idref").agg(
        F.min("pos").alias("start"), first(F.col("heading_level").isNotNull() & filled).alias("heading"),
        first(T.strip("text").rlike(CHAPTER_TITLE)).alias("marker"), first(filled).alias("opening"), F.count("*").alias("n"))
    cut = F.when(F.length("opening") > 60, F.concat(F.regexp_replace(F.substring("opening", 1, 60), r"(?U)\s+$", ""), F.lit("…"))).otherwise(F.col("opening"))
    kept = per.join(classify_spine(paragraphs), ["doc_id", "idref"]).withColumn("title", F.coalesce("heading", "marker", cut, F.lit("Untitled Chapter")))
    kept = kept.where((F.col("classification") != "front_matter") & ~is_toc(F.col("title"), F.col("idref")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "idref"))
    return kept.select("doc_id", number.alias("chapter_no"), "idref", "title", (F.col("n") - F.when(F.col("heading").isNotNull(), 1).otherwise(0)).cast("int").alias("n_paragraphs"))


def story_flags(chapters: DataFrame, book_title: Column) -> DataFrame:
    """Adds is_matter: a title that repeats the book's or names a part that is no story; where all of a book's would be, none is."""
    t, b = T.squash("title"), T.squash(book_title)
    repeated = (t != "") & (b != "") & t.startswith(b) & (F.length(t) - F.length(b) < 10)
    rows = chapters.withColumn("__m", F.coalesce(repeated, F.lit(False)) | F.coalesce(F.col("title").rlike(NON_STORY), F.lit(False)))
    every = rows.groupBy("doc_id").agg(F.bool_and("__m").alias("__all"))
    return rows.join(every, "doc_id").withColumn("is_matter", F.col("__m") & ~F.col("__all")).drop("__m", "__all")


def visible(chapters: DataFrame, book_title: Column) -> DataFrame:
    """Chapters that are story."""
    return story_flags(chapters, book_title).where("not is_matter").drop("is_matter")


def without_navigation(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """A spine (doc_id, pos, idref) without the items that the manifest marks as navigation: an anti join."""
    nav = manifest.where(F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "nav")).select("doc_id", F.col("item_id").alias("idref"))
    return spine.join(nav, ["doc_id", "idref"], "left_anti")


def worth_scanning(chapters: DataFrame, paragraphs: int = 10) -> DataFrame:
    """Chapters (with n_paragraphs) long enough to be scanned for names."""
    return chapters.where(F.col("n_paragraphs") >= paragraphs)


def chapter_bounds(starts: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, start, stop): half-open bounds of chapters from their starts; text before the first is chapter 0."""
    w = Window.partitionBy("doc_id").orderBy("start")
    rows = starts.join(totals, "doc_id").select("doc_id", "start", F.row_number().over(w).alias("chapter_no"), F.lead("start").over(w).alias("next"), "n_paragraphs")
    rows = rows.select("doc_id", "chapter_no", "start", F.coalesce("next", "n_paragraphs").alias("stop"))
    before = rows.where((F.col("chapter_no") == 1) & (F.col("start") > 0)).select("doc_id", F.lit(0).alias("chapter_no"), F.lit(0).cast(rows.schema["start"].dataType).alias("start"), F.col("start").alias("stop"))
    return rows.unionByName(before)


def sessions(log: DataFrame, keys: list[str], order: str, marker: Column) -> DataFrame:
    """Adds session: the number of markers at or before a row, which a marker starts; rows before the first are dropped."""
    return running_total(log, keys, order, marker.cast("int"), "session").where(F.col("session") > 0)


def parse_ranges(value: Column) -> Column:
    """`2,5,7-8` as a sorted array of distinct numbers; null where a part is malformed or descends."""
    parts = F.transform(F.split(value, ","), lambda p: T.strip(p))
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\d+(\s*-\s*\d+)?$") | F.coalesce(
        F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 1).try_cast("int") > F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 2).try_cast("int"), F.lit(False)))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    high = lambda p: F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
    # a descending part is refused above, but the sequence is evaluated in any case
    numbers = F.flatten(F.transform(parts, lambda p: F.sequence(low(p), F.greatest(low(p), high(p)))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.array_sort(F.array_distinct(numbers)))
