"""Text and JSON state as tables: glossaries, progress files with backups, entity files, caches, usage and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.prefix import BLOCK, forward_fill

PROGRESS = "chapter_id string, status string, chunks map<string, struct<translation string, paragraph_translations array<string>, attempts int, qa_passed boolean, flagged boolean, cache_hit boolean>>, completed_chunks array<string>, flagged_chunks array<string>"
_RESEARCH = "array<struct<title string, url string, snippet string, source string, query string, confidence double>>"
_RECORD = f"canonical_name string, entity_type string, translation string, aliases array<string>, locked boolean, source string, notes string, research_failed boolean, research {_RESEARCH}"
ENTITIES = f"version int, characters map<string, struct<{_RECORD}>>, proper_nouns map<string, struct<{_RECORD}>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 1 in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("k", "line"))
    return whole.select("file", (F.col("k") + 1).alias("line_no"), "line")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, section, term, meaning, active, is_alias): entries `Left = Right` of glossary files, each file by itself.

    `## name` opens a section, `#` before an entry switches it off, `~` makes it an alias; left sides with `.` or `:` are notes.
    """
    rows = read_lines(spark, path).select("file", "line_no", T.strip("line").alias("line"))
    rows = rows.withColumn("__head", F.when(F.col("line").rlike(r"^##\s*\S"), T.strip(F.regexp_replace("line", r"^##\s*", ""))))
    rows = forward_fill(rows, ["file"], "line_no", "__head", "section", BLOCK)
    body = T.strip(F.regexp_replace("line", "^#+", ""))
    left = T.strip(F.regexp_extract(body, r"^([^=]*)=", 1))
    right = T.strip(F.regexp_extract(body, r"^[^=]*=(.*)$", 1))
    name = T.strip(F.regexp_replace(left, "^~+", ""))
    keep = body.contains("=") & ~F.col("line").startswith("##") & (name != "") & ~name.rlike("[.:]")
    return rows.where(keep).select("file", "line_no", "section", name.alias("term"), right.alias("meaning"), (~F.col("line").startswith("#")).alias("active"), left.startswith("~").alias("is_alias"))


def active_terms(entries: DataFrame) -> DataFrame:
    """(file, term, meaning, line_no): what a run translates by: active entries with both sides, aliases with the meaning of their term."""
    from foliant.operators.glossary import resolve_aliases

    files = [r["file"] for r in entries.select("file").distinct().limit(2).collect()]
    if len(files) < 2:
        return resolve_aliases(entries).withColumn("file", F.lit(files[0] if files else None))
    keyed = entries.withColumn("term", F.concat_ws("\x01", "file", "term")).withColumn("meaning", F.when(F.col("is_alias"), F.concat_ws("\x01", "file", "meaning")).otherwise(F.col("meaning")))
    return resolve_aliases(keyed).select(F.substring_index("term", "\x01", 1).alias("file"), F.substring_index("term", "\x01", -1).alias("term"), "meaning", "line_no")


def editor_view(entries: DataFrame, order: str = "default", search: str | None = None, only_empty: bool = False, new_section: str | None = None) -> DataFrame:
    """Entries as an editor lists them: by line, latest first or by term (ties by line), narrowed by a search in any case, to entries
    without a meaning, or to those of one section."""
    rows = entries
    if search:
        rows = rows.where(F.lower("term").contains(search.lower()) | F.lower("meaning").contains(search.lower()))
    if only_empty:
        rows = rows.where(T.strip("meaning") == "")
    if new_section is not None:
        rows = rows.where(F.col("section") == new_section)
    by = {"default": ["line_no"], "latest": [F.desc("line_no")], "alphabetical": [F.lower("term"), "line_no"]}[order]
    return rows.orderBy("file", *by)


def edited(entries: DataFrame, edits: DataFrame, section: str = "tambahan") -> DataFrame:
    """(section, line_no, term, meaning, active, is_alias): entries with edits (line_no, term, meaning, active) by line; edits without a
    line are new entries under `section`, and entries whose edit has no term are gone."""
    e = edits.where("line_no is not null").select("line_no", F.col("term").alias("t"), F.col("meaning").alias("m"), F.col("active").alias("a"))
    kept = entries.join(e, "line_no", "left").where(F.col("t").isNull() | (T.strip("t") != "")).select("section", F.col("line_no").cast("double").alias("line_no"), F.coalesce("t", "term").alias("term"), F.coalesce("m", "meaning").alias("meaning"), F.coalesce("a", "active").alias("active"), "is_alias")
    last = entries.agg(F.coalesce(F.max("line_no"), F.lit(0)).alias("last"))
    new = edits.where("line_no is null").where(T.strip("term") != "").withColumn("k", F.row_number().over(Window.orderBy(F.lower("term"), "term"))).crossJoin(F.broadcast(last))  # one row
    return kept.unionByName(new.select(F.lit(section).alias("section"), (F.col("last") + F.col("k")).cast("double").alias("line_no"), "term", "meaning", F.coalesce("active", F.lit(True)).alias("active"), F.lit(False).alias("is_alias")))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Chunk states of progress files (*.json); a file that does not parse gives way to its backup (*.json.bak), if that parses."""
    def load(glob: str, rank: int) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
        x = F.from_json("value", PROGRESS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json(\.bak)?$", 1).alias("file"), x.alias("x")).where("x._bad is null and x.chapter_id is not null").select("file", F.lit(rank).alias("rank"), "x")

    both = load("*.json", 0).unionByName(load("*.json.bak", 1))
    best = both.groupBy("file").agg(F.min_by("x", "rank").alias("x"))
    c = best.select("x.chapter_id", "x.status", F.explode_outer("x.chunks").alias("chunk_id", "c"))
    return c.select("chapter_id", "chunk_id", "status", "c.translation", "c.paragraph_translations", "c.attempts", "c.qa_passed", "c.flagged", "c.cache_hit")


def read_progress_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """As read_progress, with defaults where a field is missing; files that say nothing at all are left out."""
    rows = read_progress(spark, path)
    return rows.select("chapter_id", "chunk_id", F.coalesce("status", F.lit("not_started")).alias("status"), "translation", "paragraph_translations", F.coalesce("attempts", F.lit(0)).alias("attempts"),
                       *[F.coalesce(c, F.lit(False)).alias(c) for c in ("qa_passed", "flagged", "cache_hit")])


def damaged_progress(spark: SparkSession, path: str) -> DataFrame:
    """(file): progress files that neither parse themselves nor have a backup that does."""
    names = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)\.json(?:\.bak)?$", 1).alias("file")).where("file <> ''").distinct()
    x = F.from_json("value", PROGRESS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json(?:\.bak)?$", 1).alias("file"), x.alias("x")).where("x._bad is null and x.chapter_id is not null")
    return names.join(whole.select("file"), "file", "left_anti")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity records of JSON files of versions 1 to 3; fields that older versions lack get their defaults."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ENTITIES).alias("x")).where(F.col("x.version").between(1, 3))
    out = None
    for field, default in (("characters", "character"), ("proper_nouns", "proper_noun")):
        rows = raw.select(F.explode(f"x.{field}").alias("k", "r")).select(
            F.coalesce("r.canonical_name", "k").alias("canonical_name"), F.coalesce("r.entity_type", F.lit(default)).alias("entity_type"), "r.translation",
            F.coalesce("r.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("r.locked", F.lit(False)).alias("locked"), "r.source", "r.notes",
            F.coalesce("r.research_failed", F.lit(False)).alias("research_failed"), F.coalesce("r.research", F.array().cast(_RESEARCH.replace(" string", ":string").replace(" double", ":double"))).alias("research"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_cache(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Cache entries (*.json, one a file) that passed, of the given version and with a translation; others are misses."""
    schema = "key string, cache_version int, status string, translation string, paragraph_translations array<string>"
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.from_json("value", schema).alias("x")).select("x.*")
    return rows.where((F.col("cache_version") == version) & (F.col("status") == "passed") & (T.strip("translation") != ""))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, translated) of title caches: JSON objects of strings, one a file; a file that does not parse is empty."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"), F.explode(F.from_json("value", "map<string,string>")).alias("title", "translated"))


def read_usage(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """(day, model, n) of usage files `{"2025-01-31": {"model": 3}}`, of one day or all; a file that does not parse counts nothing."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    days = rows.select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("day", "m")).select("day", F.explode("m").alias("model", "n"))
    return (days if day is None else days.where(F.col("day") == day)).groupBy("day", "model").agg(F.sum("n").alias("n"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file (file, line_no, line)."""
    from foliant.operators.prefix import newest

    return newest(lines, ["file"], [F.desc("line_no")], n, "back")


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(name, path, size, modified): files of a folder with one of the suffixes, newest first and by name among equals."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes)).orderBy(F.desc("modified"), "name")


def first_of(*listings: DataFrame) -> DataFrame:
    """Listings as one, of each name the entry of the first listing that has it."""
    out = None
    for k, part in enumerate(listings):
        part = part.withColumn("__k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    cols = [c for c in out.columns if c not in ("name", "__k")]
    return out.groupBy("name").agg(F.min_by(F.struct(*cols), F.struct("__k", "path")).alias("x")).select("name", "x.*")
