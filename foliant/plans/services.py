"""Queries of the operators around models, searches and settings, with deterministic stand-ins for the services, and their SQL.

The stand-ins answer by rule from what they are sent, so SQL can tell what must come out.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import external
from foliant.functions import markup as M
from foliant.functions import text as T
from foliant.operators import chunking, entities, glossary, model_calls, navigation, progress, stats, structure
from foliant.plans.sql import _P, _matter, _strip
from foliant.plans.sql import SQL as _CORE
from foliant.session import ship_package, table

NOVEL, AUTHOR = "The Novel", "An Author"


def _chunks(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chapter_id", "chunk_id", "chunk_no", "paragraph_texts", *more).distinct()


def _policy() -> model_calls.Retrying:
    """Fails as often as the length of the prompt says, modulo 5; four is a spent quota."""
    tries: dict[str, int] = {}

    def send(prompt: str) -> tuple[int, float | None, str]:
        k, n = len(prompt) % 5, tries.get(prompt, 0)
        tries[prompt] = n + 1
        if k == 4:
            return 429, None, "quota of requests per day"
        if n % 4 < k:
            return (429, 7.0, "busy") if k == 2 else (503, None, "down")
        return 200, None, prompt[:3]

    return model_calls.Retrying(send)


def q70_model_policy(spark, sf):
    ship_package(spark)
    prompts = table(spark, sf, "documents").where("length(text) > 0").select("text").distinct().select(F.md5("text").alias("k"), F.col("text").alias("prompt"))
    return model_calls.ask_with_policy(prompts, _policy).select("k", "attempts", "waited", F.col("answer").isNotNull().alias("served"))


def _chain():
    def first(prompt: str) -> str:
        if len(prompt) % 2:
            raise RuntimeError("refused")
        return prompt + "+"

    def second(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise OSError("down")
        return prompt + "-"

    return [("first", first), ("second", second)]


def q71_failover(spark, sf):
    ship_package(spark)
    prompts = table(spark, sf, "mentions").select(F.col("text").alias("prompt")).where("text is not null").distinct()
    return external.ask(prompts, _chain).select("prompt", "served_by", "answer", F.col("error").isNotNull().alias("failed"))


def _translator():
    """Marks each paragraph; leaves paragraphs out where it gets more than two at once."""

    def model(prompt: str) -> str:
        x = json.loads(prompt)
        return json.dumps([p + "!" for p in x["paragraphs"]][: 1 if len(x["paragraphs"]) > 2 else None])

    return model


def q72_translated_chunks(spark, sf):
    ship_package(spark)
    rows = model_calls.translated_chunks(_chunks(spark, sf).where("paragraph_texts is not null"), _translator)
    return rows.select("chapter_id", "chunk_id", F.size("paragraph_translations").alias("n"), F.md5("translation").alias("text_md5"), F.col("error").isNotNull().alias("failed"))


def _refiner():
    """Marks each paragraph with `?`; takes one mark off and adds a `.` an issue; breaks the contract for seven paragraphs."""

    def model(prompt: str) -> str:
        x = json.loads(prompt)
        if x["task"] == "translate":
            return "no list" if len(x["paragraphs"]) == 7 else json.dumps([p + "?" * (len(p) % 4) for p in x["paragraphs"]])
        return json.dumps([t[:-1] if t.endswith("?") else t for t in x["translations"]])

    return model


def q73_refined_chunks(spark, sf):
    ship_package(spark)
    rows = _chunks(spark, sf).where("size(paragraph_texts) between 1 and 12 and not exists(paragraph_texts, t -> t is null or contains(t, '?'))")

    def check(df: DataFrame) -> DataFrame:
        found = F.when(F.coalesce(F.col("translation").contains("?"), F.lit(True)), F.array(F.struct(F.lit("mark").alias("rule")))).otherwise(F.array().cast("array<struct<rule:string>>"))
        return df.withColumn("found_issues", found).withColumn("passed", F.size("found_issues") == 0)

    return model_calls.refined_chunks(rows, _refiner, check).select("chapter_id", "chunk_id", "attempts", "passed", "flagged", F.md5("translation").alias("text_md5"))


def q74_cache_guard(spark, sf):
    done = table(spark, sf, "processed_chunks").select("chapter_id", "chunk_id", "translation", F.col("qa_passed").alias("passed")).distinct()
    done = done.withColumn("served_by", F.when(F.length("translation") % 3 == 0, "second").otherwise("first"))
    key = F.concat_ws("/", "chapter_id", "chunk_id").alias("key")
    held = done.where(F.length("translation") % 2 == 0).select(key, F.lit(1).alias("cache_version"), F.lit("passed").alias("status"), F.lit("old").alias("translation")).distinct()
    cache = model_calls.put_in_cache(held, model_calls.cacheable(done, "first").select(key, "translation"))
    cache = model_calls.drop_from_cache(cache, done.where("translation is null").select(key))
    return cache.select("key", F.md5("translation").alias("text_md5"))


def _extractor():
    """Names the first word of each paragraph; types and places are wrong now and then."""

    def model(prompt: str) -> str:
        out = []
        for k, t in enumerate(json.loads(prompt)["paragraphs"]):
            n = len(t)
            out.append({"name": t[:5], "type": ("Place", "character", "poem")[n % 3], "confidence": (n % 7) / 4, "paragraph": k if n % 11 else 10**6})
        return "```json\n" + json.dumps(out) + "\n```"

    return model


def q75_extracted_entities(spark, sf):
    ship_package(spark)
    rows = table(spark, sf, "paragraphs").where("idref is not null").select(F.concat_ws("/", "doc_id", "idref").alias("chapter_id"), "pos", "paragraph_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return model_calls.extracted_entities(rows, _extractor)


def _judge_of_pages():
    def model(prompt: str) -> str:
        n = len(json.loads(prompt)["text"] or "")
        return json.dumps({"classification": ("chapter", "front_matter", "no idea")[n % 3]})

    return model


def q76_classified_spine(spark, sf):
    ship_package(spark)
    p = structure.distinct_paragraphs(table(spark, sf, "paragraphs"))
    classes = structure.classify_spine(p)
    # every second page counts as ambiguous, so that the model has something to do
    classes = classes.withColumn("classification", F.when(F.ascii(F.right("idref", F.lit(1))) % 2 == 0, "ambiguous").otherwise(F.col("classification")))
    texts = p.where("idref is not null").groupBy("doc_id", "idref").agg(F.min_by("text", "pos").alias("text"))
    return model_calls.classified_spine(classes, texts, _judge_of_pages).join(texts, ["doc_id", "idref"]).select("doc_id", "idref", "classification", "by_model")


def _researcher():
    """A search that finds as many pages as the length of the query says, modulo 7; evidence is every other of three or more."""

    def search(query: str, n: int) -> list[dict]:
        if len(query) % 7 == 6:
            raise OSError("down")
        return [{"title": "x" if k % 2 else query, "snippet": f"s{k}", "url": f"https://e.example/{k}", "source": ""} for k in range(len(query) % 7)]

    return search, lambda name, query, found: list(range(0, len(found), 2)) + [99, 0] if len(found) >= 3 else []


def q77_research(spark, sf):
    ship_package(spark)
    names = table(spark, sf, "entities").select("entity_id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("kind")).where("canonical_name is not null")
    got = model_calls.researched(names, _researcher, NOVEL, AUTHOR)
    return got.select("entity_id", "query", "n_queries", F.array_join(F.transform("results", lambda r: r["snippet"]), ",").alias("snippets"))


def q78_entity_pipeline(spark, sf):
    ship_package(spark)
    return model_calls.entity_pipeline(table(spark, sf, "mentions"), table(spark, sf, "entities"), _researcher, NOVEL, AUTHOR)


def _titler():
    def model(prompt: str) -> str:
        t = json.loads(prompt)["title"]
        return json.dumps(f"{t} (Nama)" if len(t) % 2 else t.replace(":", ""))

    return model


def q79_titles(spark, sf):
    ship_package(spark)
    heads = structure.distinct_paragraphs(table(spark, sf, "paragraphs")).where("heading_level is not null").select("doc_id", F.col("text").alias("title")).distinct()
    cache = heads.where(F.length("title") % 5 == 0).select("doc_id", "title", F.concat(F.lit("*"), F.col("title")).alias("translated"))
    return model_calls.translated_titles(heads, cache, _titler)


def _termer():
    def model(prompt: str) -> str:
        x = json.loads(prompt)
        if len(x["name"]) % 4 == 0:
            raise RuntimeError("refused")
        return json.dumps(f"{x['name']}/{len(x['evidence'])}")

    return model


def q80_terms(spark, sf):
    ship_package(spark)
    rows = table(spark, sf, "mentions").select(F.col("mention_id").alias("ord"), F.col("text").alias("name"), F.coalesce("entity_type", F.lit("lainnya")).alias("kind")).distinct()
    return model_calls.translated_terms(glossary.prune_variants(rows), table(spark, sf, "entities"), _termer)


def q81_word_pieces(spark, sf):
    ship_package(spark)
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")

    def run(batches):
        for b in batches:
            got = [chunking.word_pieces(t, 30) for t in b["text"]]
            yield b.assign(n=[len(g) for g in got], longest=[max(map(len, g)) for g in got], last=[len(g[-1]) for g in got]).drop(columns="text")

    return rows.mapInPandas(run, "doc_id bigint, n int, longest int, last int")


def q82_carried_state(spark, sf):
    ship_package(spark)
    rows = table(spark, sf, "chunks").select("chapter_id", "chunk_no", "chunk_id", F.length("text").alias("size")).distinct()
    got = navigation.carried(rows, lambda state, row: int(state or 0) + (0 if row["size"] is None or row["size"] != row["size"] else int(row["size"])), "state bigint")
    return got.select("chapter_id", "chunk_id", "state")


def q83_backed_off_starts(spark, sf):
    p = structure.distinct_paragraphs(table(spark, sf, "paragraphs"))
    starts = p.where("heading_level is not null").select("doc_id", F.col("pos").alias("head"), F.col("text").alias("title"))
    # a start stands two paragraphs behind its heading, so that heading and opening may belong to its title
    lines = p.select("doc_id", (F.col("pos") + 1).alias("next"), F.col("text").alias("own"), "pos")
    behind = starts.join(lines.select("doc_id", F.col("pos").alias("p1"), F.col("own")), F.expr("p1 = head + 1") & (starts.doc_id == lines.doc_id)).select(starts.doc_id, (F.col("head") + 2).alias("start"), F.concat_ws(" ", "title", F.when(F.length("own") % 2 == 0, F.col("own"))).alias("title"))
    return navigation.backed_off_starts(behind, p.select("doc_id", "pos", "text")).select("doc_id", "start")


def q84_markup(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.substring(F.regexp_replace("text", r"[<>&\"\\\n\r]", " "), 1, 60).alias("t"))
    page = F.concat(F.lit('<html lang="en-GB"><link rel="stylesheet" href="'), F.col("doc_id"), F.lit('.css"/><img src="a.png"/><img style="x" alt="'), F.col("t"), F.lit('/><p lang="en">'), F.col("t"), F.lit("</p></html>"))
    made = M.centered_images(M.repaired(M.mark_indonesian(page)))
    return rows.select("doc_id", F.md5(made).alias("page_md5"), M.repairs(page).alias("repaired"), F.array_join(M.stylesheet_links(page), ",").alias("sheets"))


def q85_title_lines(spark, sf):
    p = structure.distinct_paragraphs(table(spark, sf, "paragraphs")).where("heading_level is not null").select("paragraph_id", "text")
    return p.select("paragraph_id", M.title_lines(F.col("text")).alias("lines"), M.chapter_label(F.col("text")).alias("label"), M.without_label(F.col("text")).alias("name"))


def q86_settings(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("value").cast("string").alias("v"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    flag = F.element_at(F.array(*map(F.lit, (" Yes", "on", "0", "no", "TRUE"))), (F.col("event_id") % 5 + 1).cast("int"))
    return rows.select("event_id", M.coerced(F.col("k"), "int").alias("as_int"), M.coerced(flag, "bool").alias("as_bool"), M.coerced(F.col("event_type"), "int").isNull().alias("no_number"),
                       M.share(F.col("k")).alias("share"), T.backoff_seconds(F.when(F.col("event_id") % 3 == 0, F.col("k")), F.col("event_id") % 7).alias("delay"))


def q87_names_of_files(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 40).alias("t"), F.element_at(F.array(*map(F.lit, ("PNG", "jpeg", "svg", "txt"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("suffix"))
    return rows.select("doc_id", T.media_type(F.concat(F.lit("img/a."), F.col("suffix"))).alias("media"), M.download_name(F.lit("A: b/c?"), F.col("suffix")).alias("file"),
                       T.numbered("chapter_", 3, F.col("doc_id")).alias("chapter"), M.safe_name(F.concat(F.when(F.col("doc_id") % 3 == 0, "../").otherwise(""), F.lit("a."), F.col("suffix"))).alias("safe"))


def q88_kept_translations(spark, sf):
    c = _chunks(spark, sf).where("paragraph_texts is not null and not exists(paragraph_texts, t -> t is null)")
    p = table(spark, sf, "processed_chunks").where("paragraph_translations is not null").groupBy("chapter_id", "chunk_id").agg(F.max("paragraph_translations").alias("t"))
    rows = c.join(p, ["chapter_id", "chunk_id"])
    kept = T.kept_source(F.col("paragraph_texts"), F.col("t"))
    return rows.select("chapter_id", "chunk_id", F.size(kept).alias("n"), F.md5(F.array_join(kept, "\n", "~")).alias("text_md5"), model_calls.needs_model(F.col("paragraph_texts")).alias("needs_model"))


def q89_run_actions(spark, sf):
    status = progress.chapter_status(table(spark, sf, "chunks"), table(spark, sf, "progress"))
    return status.select("chapter_id", progress.action(F.col("total") % 2 == 0, F.col("status")).alias("action"))


def q90_visible_chapters(spark, sf):
    p = structure.distinct_paragraphs(table(spark, sf, "paragraphs"))
    rows = structure.worth_scanning(structure.split_by_spine(p), 10)
    return structure.visible(rows.select("doc_id", "chapter_no", "title", "n_paragraphs"), F.col("doc_id")).select("doc_id", "chapter_no", "title")


def q91_mention_sources(spark, sf):
    p = structure.distinct_paragraphs(table(spark, sf, "paragraphs"))
    return entities.with_paragraphs(table(spark, sf, "mentions").select("mention_id", "text", "source_paragraph_id").distinct(), p).select("mention_id", F.md5("paragraph_text").alias("text_md5"))


def q91_entity_counts(spark, sf):
    return entities.counted(table(spark, sf, "entities"))


def q91_run_counters(spark, sf):
    p = table(spark, sf, "chunks").select("chapter_id", F.explode("paragraph_ids").alias("paragraph_id"))
    where = p.groupBy(F.col("paragraph_id").alias("source_paragraph_id")).agg(F.min("chapter_id").alias("chapter_id"))
    firsts = entities.resolve_mentions(entities.first_wins(entities.normal_mentions(table(spark, sf, "mentions"))), table(spark, sf, "entities"))
    return stats.run_counters(p, table(spark, sf, "processed_chunks"), firsts.join(where, "source_paragraph_id"))


def q91_names_in_order(spark, sf):
    return entities.names_in_order(table(spark, sf, "mentions").where("text is not null"), "mention_id", "text")


def q91_usage_lines(spark, sf):
    used = progress.usage(table(spark, sf, "events"), "ts", "event_type").where("day is not null")
    return progress.usage_line(used.select(F.col("day").cast("string").alias("day"), F.col("event_type").alias("model"), "n"))


def q91_next_chunks(spark, sf):
    return progress.next_chunk(progress.chapter_status(table(spark, sf, "chunks"), table(spark, sf, "progress")))


def q92_valid_indices(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.array((F.col("event_id") % 5).cast("int"), F.lit(-1), F.lit(2), (F.col("event_id") % 5).cast("int")).alias("x"))
    return rows.select("event_id", F.array_join(M.valid_indices(F.col("x"), F.lit(3)), ",").alias("valid"), F.size(external.chains(F.lit("a:m1, m2 ,b:c:m3,"))).alias("n_chain"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}

_KIND = "CASE entity_type WHEN 'character' THEN ' character' WHEN 'place' THEN ' location' WHEN 'organization' THEN ' organization' WHEN 'item' THEN ' item' WHEN 'skill' THEN ' skill' WHEN 'race' THEN ' race' WHEN 'title' THEN ' title' ELSE '' END"
_QUERIES = f"""q1 AS (SELECT *, '"' || name || '"' || {_KIND} || ' "{NOVEL}"' AS a FROM n),
q2 AS (SELECT *, a || ' "{AUTHOR}"' AS b FROM q1),
q3 AS (SELECT *, length(a) % 7 BETWEEN 3 AND 5 AS hit_a, length(b) % 7 BETWEEN 3 AND 5 AS hit_b FROM q2),
q4 AS (SELECT *, CASE WHEN hit_a THEN a ELSE b END AS query, CASE WHEN hit_a THEN 1 ELSE 2 END AS n_queries,
  CASE WHEN hit_a THEN length(a) % 7 WHEN hit_b THEN length(b) % 7 ELSE 0 END AS k FROM q3)"""
_TEXT = "coalesce(text, '')"

SQL = {
    "q70_model_policy": """
SELECT md5(text) AS k, CAST(CASE WHEN length(text) % 5 = 4 THEN 1 WHEN length(text) % 5 = 3 THEN 3 ELSE length(text) % 5 + 1 END AS INTEGER) AS attempts,
  CAST(CASE length(text) % 5 WHEN 1 THEN 2 WHEN 2 THEN 14 WHEN 3 THEN 6 ELSE 0 END AS DOUBLE) AS waited, length(text) % 5 < 3 AS served
FROM (SELECT DISTINCT text FROM documents WHERE length(text) > 0)""",
    "q71_failover": """
SELECT text AS prompt, CASE WHEN length(text) % 2 = 0 THEN 'first' WHEN length(text) % 3 <> 0 THEN 'second' END AS served_by,
  CASE WHEN length(text) % 2 = 0 THEN text || '+' WHEN length(text) % 3 <> 0 THEN text || '-' END AS answer, length(text) % 2 = 1 AND length(text) % 3 = 0 AS failed
FROM (SELECT DISTINCT text FROM mentions WHERE text IS NOT NULL)""",
    "q72_translated_chunks": f"""
WITH c AS (SELECT DISTINCT chapter_id, chunk_id, chunk_no, list_transform(paragraph_texts, lambda t: coalesce(t, '')) AS t FROM chunks WHERE paragraph_texts IS NOT NULL),
d AS (SELECT *, len(list_filter(t, lambda x: {_strip('x')} <> '')) = 0 AS blank, len(t) > 16 AS broken FROM c)
SELECT chapter_id, chunk_id, CASE WHEN blank OR NOT broken THEN CAST(len(t) AS INTEGER) END AS n,
  CASE WHEN blank THEN md5(array_to_string(t, chr(10))) WHEN NOT broken THEN md5(array_to_string(list_transform(t, lambda x: x || '!'), chr(10))) END AS text_md5, broken AND NOT blank AS failed FROM d""",
    "q73_refined_chunks": """
WITH c AS (SELECT DISTINCT chapter_id, chunk_id, chunk_no, paragraph_texts AS t FROM chunks WHERE len(paragraph_texts) BETWEEN 1 AND 12 AND len(list_filter(paragraph_texts, lambda x: x IS NULL OR contains(x, '?'))) = 0),
d AS (SELECT *, list_max(list_transform(t, lambda x: length(x) % 4)) AS k, len(t) = 7 AS broken FROM c)
SELECT chapter_id, chunk_id, CAST(CASE WHEN broken THEN 3 ELSE least(k, 2) + 1 END AS INTEGER) AS attempts, NOT broken AND k <= 2 AS passed, broken OR k > 2 AS flagged,
  CASE WHEN NOT broken THEN md5(array_to_string(list_transform(t, lambda x: x || repeat('?', greatest(length(x) % 4 - 2, 0))), chr(10))) END AS text_md5 FROM d""",
    "q74_cache_guard": f"""
WITH d AS (SELECT DISTINCT chapter_id || '/' || chunk_id AS key, translation, qa_passed FROM processed_chunks),
f AS (SELECT key, max(translation) AS t FROM d WHERE qa_passed AND length(translation) % 3 <> 0 AND {_strip('translation')} <> '' GROUP BY key),
h AS (SELECT DISTINCT key FROM d WHERE length(translation) % 2 = 0)
SELECT key, md5(coalesce(f.t, 'old')) AS text_md5 FROM h FULL JOIN f USING (key) WHERE key NOT IN (SELECT key FROM d WHERE translation IS NULL)""",
    "q75_extracted_entities": f"""
WITH r AS (SELECT DISTINCT doc_id || '/' || idref AS chapter_id, pos, paragraph_id, {_TEXT} AS text FROM paragraphs WHERE idref IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY pos, paragraph_id, text) - 1 AS ord, length(text) AS n FROM r)
SELECT chapter_id, CAST(ord AS INTEGER) AS ord, {_strip('left(text, 5)')} AS text, CASE n % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'character' ELSE 'proper_noun' END AS entity_type,
  CAST(least((n % 7) / 4.0, 1.0) AS DOUBLE) AS confidence, paragraph_id AS source_paragraph_id FROM x WHERE n % 11 <> 0 AND {_strip('left(text, 5)')} <> ''""",
    "q76_classified_spine": f"""
WITH s AS ({_CORE["q27_spine_classes"]}), {_P}, t AS (SELECT doc_id, idref, arg_min(text, pos) AS text FROM p WHERE idref IS NOT NULL GROUP BY ALL),
x AS (SELECT doc_id, idref, classification, ascii(right(idref, 1)) % 2 = 0 OR classification = 'ambiguous' AS unsure, length(text) % 3 AS k FROM s JOIN t USING (doc_id, idref))
SELECT doc_id, idref, CASE WHEN NOT unsure THEN classification WHEN k = 0 THEN 'chapter' WHEN k = 1 THEN 'front_matter' ELSE 'ambiguous' END AS classification, unsure AND k < 2 AS by_model FROM x""",
    "q77_research": f"""
WITH n AS (SELECT entity_id, canonical_name AS name, entity_type FROM entities WHERE canonical_name IS NOT NULL), {_QUERIES}
SELECT entity_id, query, CAST(n_queries AS INTEGER) AS n_queries, CASE k WHEN 3 THEN 's0,s2' WHEN 4 THEN 's0,s2' WHEN 5 THEN 's0,s2,s4' ELSE '' END AS snippets FROM q4""",
    "q78_entity_pipeline": f"""
WITH r AS ({_CORE["q42_resolved_mentions"]}), e AS ({_CORE["q15_valid_mentions"].split(" WHERE source_paragraph_id IN")[0]}),
n AS (SELECT r.mention_id, r.text AS name, min(e.entity_type) AS entity_type FROM r JOIN e USING (mention_id) WHERE status = 'new' GROUP BY ALL), {_QUERIES}
SELECT r.mention_id, r.text, r.entity_id, CASE WHEN r.status <> 'new' THEN r.status WHEN coalesce(q4.k, 0) > 0 THEN 'created' ELSE 'research_failed' END AS status, CAST(coalesce(ceil(q4.k / 2.0), 0) AS INTEGER) AS n_valid FROM r LEFT JOIN q4 USING (mention_id)""",
    "q79_titles": f"""
WITH {_P}, t AS (SELECT DISTINCT doc_id, text AS title FROM p WHERE heading_level IS NOT NULL),
x AS (SELECT *, regexp_matches({_strip('title')}, '^chapter\\s+\\d+$', 'i') AS label, regexp_matches({_strip('title')}, '^Chapter\\s+\\d+\\s*:\\s*.+$', 'is') AS strict FROM t)
SELECT doc_id, title, CASE WHEN label THEN {_strip('title')} || ' (Bab ' || regexp_extract(title, '(\\d+)', 1) || ')' WHEN length(title) % 5 = 0 THEN '*' || title
    WHEN length(title) % 2 = 1 THEN title || ' (Nama)' WHEN strict THEN title ELSE CASE WHEN {_strip("replace(title, ':', '')")} = '' THEN title ELSE replace(title, ':', '') END END AS translated,
  CASE WHEN label THEN 'label' WHEN length(title) % 5 = 0 THEN 'cache' WHEN length(title) % 2 = 1 THEN 'model' WHEN strict OR {_strip("replace(title, ':', '')")} = '' THEN 'refused' ELSE 'model' END AS origin FROM x""",
    "q80_terms": f"""
WITH t AS ({_CORE["q47_term_meanings"]})
SELECT name, CASE WHEN meaning IS NOT NULL THEN meaning WHEN length(name) % 4 <> 0 THEN name || '/' || n_snippets END AS meaning,
  CASE WHEN meaning IS NOT NULL THEN 'entities' WHEN length(name) % 4 <> 0 THEN 'model' ELSE 'none' END AS origin FROM t""",
    "q81_word_pieces": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\v\\x{85}\\x{1C}-\\x{1F}\\p{Z}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, w, 0 AS i, 0 AS size, 0 AS n, 0 AS longest FROM w
  UNION ALL SELECT doc_id, w, i + 1, CASE WHEN size > 0 AND size + 1 + length(w[i + 1]) <= 120 THEN size + 1 + length(w[i + 1]) ELSE length(w[i + 1]) END,
    CASE WHEN size > 0 AND size + 1 + length(w[i + 1]) <= 120 THEN n ELSE n + 1 END,
    greatest(longest, CASE WHEN size > 0 AND size + 1 + length(w[i + 1]) <= 120 THEN size + 1 + length(w[i + 1]) ELSE length(w[i + 1]) END) FROM f WHERE i < len(w))
SELECT doc_id, CAST(greatest(n, 1) AS INTEGER) AS n, CAST(longest AS INTEGER) AS longest, CAST(size AS INTEGER) AS last FROM f WHERE i = len(w)""",
    "q83_backed_off_starts": f"""
WITH {_P}, h AS (SELECT doc_id, pos AS head, text AS title FROM p WHERE heading_level IS NOT NULL),
s AS (SELECT h.doc_id, head + 2 AS start, concat_ws(' ', title, CASE WHEN length(text) % 2 = 0 THEN text END) AS title, lag(head + 2) OVER (PARTITION BY h.doc_id ORDER BY head) AS before
  FROM h JOIN p ON p.doc_id = h.doc_id AND p.pos = head + 1),
q AS (SELECT doc_id, pos, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS sq FROM p),
j AS (SELECT s.doc_id, s.start, max(q.pos) FILTER (NOT (length(sq) >= 6 AND contains(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), sq))) AS stop, min(q.pos) AS low
  FROM s LEFT JOIN q ON q.doc_id = s.doc_id AND q.pos < s.start AND q.pos > coalesce(before, -1) GROUP BY ALL)
SELECT doc_id, CAST(coalesce(stop + 1, low, start) AS INTEGER) AS start FROM j""",
    "q82_carried_state": """
SELECT chapter_id, chunk_id, CAST(sum(coalesce(size, 0)) OVER (PARTITION BY chapter_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state
FROM (SELECT DISTINCT chapter_id, chunk_no, chunk_id, length(text) AS size FROM chunks)""",
    "q84_markup": """
WITH r AS (SELECT doc_id, left(regexp_replace(text, '[<>&"\\\\\\n\\r]', ' ', 'g'), 60) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5('<html lang="id"><link rel="stylesheet" href="' || doc_id || '.css"/><img src="a.png" style="display:block;margin:0 auto;width:100%;height:auto"/><img style="display:block;margin:0 auto;width:100%;height:auto;x" alt="' || t || '"/><p lang="id">' || t || '</p></html>') AS page_md5,
  CAST(1 AS INTEGER) AS repaired, doc_id || '.css' AS sheets FROM r""",
    "q85_title_lines": f"""
WITH {_P}, x AS (SELECT paragraph_id, text, regexp_extract(text, '^((?:Bab|Chapter|Extra Chapter)[^:]*?):\\s*', 1) AS l, regexp_replace(text, '^((?:Bab|Chapter|Extra Chapter)[^:]*?):\\s*', '') AS n FROM p WHERE heading_level IS NOT NULL)
SELECT paragraph_id, CASE WHEN l <> '' THEN {_strip('l')} || chr(9246) || n ELSE text END AS lines, {_strip('l')} AS label, n AS name FROM x""",
    "q86_settings": """
WITH r AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, TRY_CAST(k AS INTEGER) AS as_int, event_id % 5 IN (0, 1, 4) AS as_bool, true AS no_number, CAST(least(greatest(coalesce(TRY_CAST(k AS DOUBLE), 0), 0), 1) AS DOUBLE) AS share,
  least(coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(k AS DOUBLE) END, 2.0 * pow(2.0, event_id % 7)), 60.0) AS delay FROM r""",
    "q87_names_of_files": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS media,
  'A b c.' || lower(['PNG', 'jpeg', 'svg', 'txt'][doc_id % 4 + 1]) AS file, 'chapter_' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS chapter, doc_id % 3 <> 0 AS safe
FROM documents WHERE text IS NOT NULL""",
    "q88_kept_translations": f"""
WITH c AS (SELECT DISTINCT chapter_id, chunk_id, chunk_no, paragraph_texts AS s FROM chunks WHERE paragraph_texts IS NOT NULL AND len(list_filter(paragraph_texts, lambda t: t IS NULL)) = 0),
p AS (SELECT chapter_id, chunk_id, max(paragraph_translations) AS t FROM processed_chunks WHERE paragraph_translations IS NOT NULL GROUP BY ALL),
k AS (SELECT chapter_id, chunk_id, s, CASE WHEN len(s) = len(t) THEN list_transform(list_zip(s, t), lambda z: CASE WHEN NOT regexp_matches(z[1], '\\p{{L}}') OR regexp_matches({_strip('z[1]')}, '^(https?://|www\\.)\\S+$', 'i') THEN z[1] ELSE z[2] END) ELSE t END AS x FROM c JOIN p USING (chapter_id, chunk_id))
SELECT chapter_id, chunk_id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(list_transform(x, lambda v: coalesce(v, '~')), chr(10))) AS text_md5, len(list_filter(s, lambda v: {_strip('v')} <> '')) > 0 AS needs_model FROM k""",
    "q89_run_actions": f"""
WITH s AS ({_CORE["q05_chapter_status"]}) SELECT chapter_id, CASE WHEN status = 'completed' THEN 'restore' WHEN total % 2 = 0 THEN 'translate' ELSE 'skip' END AS action FROM s""",
    "q90_visible_chapters": f"""
WITH t AS (SELECT doc_id, chapter_no, title FROM ({_CORE["q28_spine_chapters"]}) WHERE n_paragraphs >= 10), {_matter('t')},
z AS (SELECT *, m AND NOT bool_and(m) OVER (PARTITION BY doc_id) AS is_matter FROM y) SELECT doc_id, chapter_no, title FROM z WHERE NOT is_matter""",
    "q91_mention_sources": f"""
WITH {_P}, f AS (SELECT paragraph_id, arg_min(text, {{'a': doc_id, 'b': pos}}) AS t FROM p GROUP BY paragraph_id)
SELECT DISTINCT mention_id, md5(f.t) AS text_md5 FROM (SELECT DISTINCT mention_id, text, source_paragraph_id FROM mentions) m LEFT JOIN f ON f.paragraph_id = m.source_paragraph_id""",
    "q91_entity_counts": f"""
SELECT CASE WHEN lower({_strip('entity_type')}) = 'character' THEN 'characters' ELSE 'proper_nouns' END AS category, count(DISTINCT entity_id) AS n FROM entities GROUP BY 1""",
    "q91_run_counters": f"""
WITH p AS (SELECT chapter_id, unnest(paragraph_ids) AS paragraph_id FROM chunks), w AS (SELECT paragraph_id, min(chapter_id) AS chapter_id FROM p GROUP BY 1),
r AS ({_CORE["q42_resolved_mentions"]}), m AS (SELECT DISTINCT mention_id, arg_min(source_paragraph_id, ord) OVER (PARTITION BY mention_id) AS sp FROM mentions),
e AS (SELECT w.chapter_id, r.status FROM r JOIN m USING (mention_id) JOIN w ON w.paragraph_id = m.sp),
a AS (SELECT chapter_id, count(*) AS paragraphs FROM (SELECT DISTINCT * FROM p) GROUP BY ROLLUP (chapter_id)),
b AS (SELECT chapter_id, count(*) AS entities, count(*) FILTER (status = 'research_failed') AS research_failed FROM e GROUP BY ROLLUP (chapter_id)),
c AS ({_CORE["q06_chapter_stats"]}), k AS (SELECT chapter_id FROM a UNION SELECT chapter_id FROM b UNION SELECT chapter_id FROM c)
SELECT k.chapter_id, coalesce(chunks, 0) AS chunks, coalesce(completed, 0) AS completed, coalesce(flagged, 0) AS flagged, coalesce(cache_hits, 0) AS cache_hits, coalesce(attempts, 0) AS attempts, coalesce(retries, 0) AS retries, coalesce(issues, 0) AS issues,
  coalesce(paragraphs, 0) AS paragraphs, coalesce(entities, 0) AS entities, coalesce(research_failed, 0) AS research_failed
FROM k LEFT JOIN a ON a.chapter_id IS NOT DISTINCT FROM k.chapter_id LEFT JOIN b ON b.chapter_id IS NOT DISTINCT FROM k.chapter_id LEFT JOIN c ON c.chapter_id IS NOT DISTINCT FROM k.chapter_id""",
    "q91_names_in_order": f"SELECT {_strip('text')} AS name, min(mention_id) AS ord FROM mentions WHERE {_strip('text')} <> '' GROUP BY 1",
    "q91_usage_lines": """
WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type || ' ' || count(*) || 'x' AS p FROM events WHERE ts IS NOT NULL GROUP BY strftime(ts, '%Y-%m-%d'), event_type) SELECT day, string_agg(p, ' · ' ORDER BY p) AS line FROM u GROUP BY day""",
    "q91_next_chunks": f"""
WITH s AS ({_CORE["q05_chapter_status"]}) SELECT chapter_id, 'chunk ' || least(done + 1, total) || '/' || total AS line FROM s WHERE status = 'in_progress' AND total > 0""",
    "q92_valid_indices": """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN (event_id % 5) || ',2' ELSE '2' END AS valid, CAST(3 AS INTEGER) AS n_chain FROM events""",
}
