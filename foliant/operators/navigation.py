"""Labels of navigation points, parts of books, and starts of chapters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.prefix import BLOCK, forward_fill


def updated_labels(points: DataFrame, titles: DataFrame) -> DataFrame:
    """Navigation points (doc_id, pos, href, label) with the label of their target's title: by whole href, else without its fragment."""
    t = titles.select("doc_id", F.col("href").alias("key"), "title").dropDuplicates(["doc_id", "key"])
    rows = points.withColumn("key", F.col("href")).join(t.withColumnRenamed("title", "whole"), ["doc_id", "key"], "left").drop("key")
    rows = rows.withColumn("key", F.regexp_replace("href", "#.*$", "")).join(t.withColumnRenamed("title", "part"), ["doc_id", "key"], "left")
    return rows.select("doc_id", "pos", "href", F.coalesce("whole", "part", "label").alias("label"))


def titles_by_href(chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, href, title): a page's chapter title, else its first heading, else its first text.

    chapters (doc_id, href, title), paragraphs (doc_id, href, pos, heading_level, text).
    """
    first = lambda cond: F.min_by(F.when(cond, T.strip("text")), F.when(cond, F.col("pos")))
    filled = T.strip("text") != ""
    pages = paragraphs.groupBy("doc_id", "href").agg(first(F.col("heading_level").isNotNull() & filled).alias("heading"), first(filled).alias("opening"))
    named = chapters.groupBy("doc_id", "href").agg(F.min("title").alias("title"))
    return pages.join(named, ["doc_id", "href"], "full_outer").select("doc_id", "href", F.coalesce("title", "heading", "opening").alias("title"))


def referenced_media(members: DataFrame, pages: DataFrame) -> DataFrame:
    """Media members whose file name a page of their book mentions: an equi-join on the names that pages contain."""
    names = pages.select("doc_id", F.explode(F.regexp_extract_all("html", F.lit(r"([^/\"'()\s=<>]+\.(?:png|jpe?g|gif|webp|svg))"), F.lit(1))).alias("base")).distinct()
    return members.withColumn("base", F.regexp_extract("name", r"([^/]+)$", 1)).join(names, ["doc_id", "base"], "left_semi").drop("base")


def book_part(idrefs: DataFrame, manifest: DataFrame, spine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest and spine of a part of a book: the chosen pages, and the manifest's items that are no pages."""
    keys = idrefs.select("doc_id", "idref").distinct()
    of_spine = spine.join(keys, ["doc_id", "idref"], "left_semi")
    pages = spine.select("doc_id", F.col("idref").alias("item_id")).distinct()
    others = manifest.join(pages, ["doc_id", "item_id"], "left_anti")
    return manifest.join(keys.withColumnRenamed("idref", "item_id"), ["doc_id", "item_id"], "left_semi").unionByName(others), of_spine


def backed_off_starts(starts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Starts (doc_id, start, title) moved back over the paragraphs right before them whose squashed text (six characters or more) is
    part of the title, however many, and never into the chapter before. A missing position stops the way back."""
    rows = paragraphs.select("doc_id", "pos", T.squash("text").alias("sq")).join(starts.withColumn("pos", F.col("start")), ["doc_id", "pos"], "full_outer")
    # backwards, each paragraph meets the next start first
    back = rows.withColumn("back", -F.col("pos"))
    ahead = forward_fill(forward_fill(back, ["doc_id"], "back", "start", "next", BLOCK), ["doc_id"], "back", "title", "its_title", BLOCK).where(F.col("next").isNotNull() & (F.col("pos") < F.col("next")))
    stops = ahead.where(~F.coalesce((F.length("sq") >= 6) & F.contains(T.squash("its_title"), F.col("sq")), F.lit(False)) | F.col("start").isNotNull())
    stop = stops.groupBy("doc_id", F.col("next").alias("start")).agg(F.max("pos").alias("stop"))
    # paragraphs between the stop and the start must be there without a gap
    between = ahead.join(stop.withColumnRenamed("start", "next"), ["doc_id", "next"], "left").where(F.coalesce(F.col("pos") > F.col("stop"), F.lit(True)))
    run = between.groupBy("doc_id", F.col("next").alias("start")).agg(F.count("*").alias("n"), F.min("pos").alias("low"))
    moved = F.when(F.col("n") == F.col("start") - F.col("low"), F.col("low")).otherwise(F.col("start"))
    return starts.join(run, ["doc_id", "start"], "left").select("doc_id", F.coalesce(moved, "start").cast("int").alias("start"), "title")


def carried(chunks: DataFrame, step, state_schema: str = "state string", key: str = "chapter_id", order: str = "chunk_no") -> DataFrame:
    """Chunks with the state that `step(state, row)` carries from one chunk of a chapter to the next, in order.

    Rows are sorted inside partitions and one pass holds one state, so a chapter of any length needs no more memory than a short one.
    """
    rows = chunks.repartition(key).sortWithinPartitions(key, order)
    name = state_schema.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if row[key] != at:
                    at, state = row[key], None
                state = step(state, row)
                out.append(state)
            yield b.assign(**{name: out})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{ddl}, {state_schema}")


def heading_level(tag: Column) -> Column:
    return F.regexp_extract(F.lower(tag), "^h([1-6])$", 1).try_cast("int")
