"""Rule checks on translated chunks, and structural checks on archives; each yields an array of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# Words that tell English, and openings that a model adds to a translation.
ENGLISH_WORDS = ("the", "and", "you", "that", "this", "what", "is", "are", "was", "to", "of", "it", "my", "me", "your", "with", "for", "not", "but", "just", "so", "want", "how", "can", "be", "do", "i")
ADDED_OPENINGS = ("Translation:", "Here is the translation:", "Here is your translation:", "Translator's note:", "Note:")

# Fixed patterns: what counts as a URL and as a quoted span inside a line.
URL_IN_LINE = r"https?://\S+|www\.\S+"
QUOTED_SPAN = r'“([^”\n]*)”|"([^"\n]*)"'
# Codes of the faults of archives.
ARCHIVE_RULES = ("MIMETYPE_EXISTS", "MIMETYPE_UNIQUE", "MIMETYPE_FIRST", "MIMETYPE_UNCOMPRESSED", "MIMETYPE_VALUE", "CONTAINER_EXISTS", "OPF_MANIFEST_ID", "OPF_MANIFEST_HREF",
                 "OPF_DUPLICATE_MANIFEST_ID", "OPF_RESOURCE_EXISTS", "OPF_SPINE_REFERENCE", "OPF_SPINE", "OPF_MANIFEST")

ISSUE = "struct<rule:string,message:string,severity:string>"


def _issue(rule: str, message: Column | str, severity: str = "error") -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule).alias("rule"), m.alias("message"), F.lit(severity).alias("severity"))


def _if(cond: Column, issue: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(issue)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def english_sentence(line: Column) -> Column:
    """Whether a line has a sentence of at least four words of which two or more tell English.

    URLs are left out, and quoted spans of at most eight words without inner punctuation (titles, names).
    """
    t, span = F.regexp_replace(line, URL_IN_LINE, " "), QUOTED_SPAN
    between, quoted = F.split(t, span, -1), F.regexp_extract_all(t, F.lit(span), F.lit(0))

    def kept(q: Column) -> Column:
        inner = F.substring(q, 2, F.length(q) - 2)
        words = F.size(F.filter(F.split(T.strip(inner), r"\s+"), lambda w: w != ""))
        return F.when((words <= 8) & ~inner.rlike("[.,!?;:]"), " ").otherwise(q)

    t = F.array_join(F.zip_with(between, F.transform(quoted, kept), lambda b, q: F.concat(F.coalesce(b, F.lit("")), F.coalesce(q, F.lit("")))), "")
    told = F.array(*map(F.lit, ENGLISH_WORDS))

    def english(s: Column) -> Column:
        words = F.regexp_extract_all(F.lower(s), F.lit("[a-z']+"), F.lit(0))
        return (F.size(words) >= 4) & (F.size(F.filter(words, lambda w: F.array_contains(told, w))) >= 2)

    return F.exists(F.split(t, "[.!?]+"), english)


def issues(source: Column, translation: Column, names: Column | None = None) -> Column:
    """All issues of a translated chunk, in the order of the rules; `names` are entity names that must stay as they are."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(translation, F.lit(""))
    s_lines, t_lines = F.split(s, "\n", -1), F.split(t, "\n", -1)
    no_lines = F.array().cast(f"array<{ISSUE}>")

    def per_line(rule: str, bad, message: str) -> Column:
        rows = F.transform(t_lines, lambda x, i: F.when(bad(x, i), _issue(rule, F.concat(F.lit(message + " "), (i + 1).cast("string")))))
        return F.when(t == "", no_lines).otherwise(F.filter(rows, lambda r: r.isNotNull()))

    blank = lambda c: T.strip(c) == ""
    empty = _if(blank(t), _issue("translation_not_empty", "no translation"))
    count = _if(T.paragraph_count(s) != T.paragraph_count(t), _issue("paragraph_count", "source and translation differ in paragraphs"))
    hollow = per_line("empty_paragraph", lambda x, i: blank(x) & ~((i < F.size(s_lines)) & blank(F.coalesce(F.get(s_lines, i), F.lit("x")))), "empty paragraph")
    kept = no_lines
    if names is not None:
        gone = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: (T.strip(n) != "") & T.normal_name(s).contains(T.normal_name(n)) & ~F.lower(t).contains(F.lower(T.strip(n))))
        kept = F.transform(gone, lambda n: _issue("preserved_entity", F.concat(F.lit("missing "), n)))
    opening = F.lit(False)
    for o in ADDED_OPENINGS:
        opening = opening | F.lower(T.strip(t)).startswith(o.lower())
    added = _if(opening, _issue("unexpected_model_text", "added opening"))
    english = per_line("untranslated_english", lambda x, i: english_sentence(x), "English in paragraph")
    echo = per_line("source_echo", lambda x, i: x.contains("->") | x.contains("→"), "source in paragraph")
    return F.concat(empty, count, hollow, kept, added, english, echo)


def check(pairs: DataFrame, source: str = "source", translation: str = "translation", names: str | None = None) -> DataFrame:
    """Adds issues, and passed: no issue."""
    found = issues(F.col(source), F.col(translation), F.col(names) if names else None)
    return pairs.withColumn("found_issues", found).withColumn("passed", F.size("found_issues") == 0)


def archive_issues(members: DataFrame, manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(doc_id, rule, message, severity): structural faults of archives.

    members (doc_id, pos, name, size, stored, content), manifest (doc_id, item_id, href, path, media_type), spine (doc_id, pos, idref).
    """

    def rows(df: DataFrame, rule: str, message: Column | str) -> DataFrame:
        m = F.lit(message) if isinstance(message, str) else message
        return df.select("doc_id", F.lit(rule).alias("rule"), m.alias("message"), F.lit("error").alias("severity"))

    docs = members.groupBy("doc_id").agg(
        F.count_if(F.col("name") == "mimetype").alias("mime"), F.min_by("name", "pos").alias("first"), F.count_if(F.col("name") == "META-INF/container.xml").alias("container"))
    mime = members.where(F.col("name") == "mimetype")
    missing = manifest.join(members.select("doc_id", F.col("name").alias("path")), ["doc_id", "path"], "left_anti")
    dangling = spine.join(manifest.select("doc_id", F.col("item_id").alias("idref")), ["doc_id", "idref"], "left_anti")
    repeated = manifest.groupBy("doc_id", "item_id").count().where("count > 1")
    found = [
        rows(docs.where("mime = 0"), "MIMETYPE_EXISTS", "no mimetype"),
        rows(docs.where("mime > 1"), "MIMETYPE_UNIQUE", "several mimetypes"),
        rows(docs.where("mime > 0 and first <> 'mimetype'"), "MIMETYPE_FIRST", "mimetype is not first"),
        rows(mime.where(~F.col("stored")), "MIMETYPE_UNCOMPRESSED", "mimetype is compressed"),
        rows(mime.where(T.strip(F.col("content").cast("string")) != "application/epub+zip"), "MIMETYPE_VALUE", "wrong mimetype"),
        rows(docs.where("container = 0"), "CONTAINER_EXISTS", "no container"),
        rows(manifest.where("coalesce(item_id, '') = ''"), "OPF_MANIFEST_ID", "item without id"),
        rows(manifest.where("coalesce(href, '') = ''"), "OPF_MANIFEST_HREF", F.concat(F.lit("item without href "), F.coalesce("item_id", F.lit("")))),
        rows(repeated, "OPF_DUPLICATE_MANIFEST_ID", F.concat(F.lit("repeated id "), F.col("item_id"))),
        rows(missing, "OPF_RESOURCE_EXISTS", F.concat(F.lit("missing "), F.col("path"))),
        rows(dangling, "OPF_SPINE_REFERENCE", F.concat(F.lit("unknown idref "), F.col("idref"))),
        rows(docs.select("doc_id").join(spine.select("doc_id").distinct(), "doc_id", "left_anti"), "OPF_SPINE", "empty spine"),
        rows(docs.select("doc_id").join(manifest.select("doc_id").distinct(), "doc_id", "left_anti"), "OPF_MANIFEST", "empty manifest"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def archives_passed(archives: DataFrame, faults: DataFrame) -> DataFrame:
    """(doc_id, passed): archives without a fault of severity error."""
    bad = faults.where("severity = 'error'").select("doc_id", F.lit(False).alias("p")).distinct()
    return archives.select("doc_id").distinct().join(bad, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(True)).alias("passed"))
