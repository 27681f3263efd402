"""Queries of the engine's own operators over the test tables, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import assemble, chunking, entities, glossary, prefix, progress, qa, stats, structure
from foliant.plans.sql import SQL  # noqa: F401
from foliant.session import ship_package, table

#: Tokens of a packed chunk.
PACK_LIMIT = 1200


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return structure.distinct_paragraphs(table(spark, sf, "paragraphs"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chapter_id", "chunk_no", "chunk_id", "paragraph_ids", "paragraph_texts", "text").distinct()


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "processed_chunks").select("chapter_id", "chunk_id", "translation").distinct()
    return table(spark, sf, "chunks").select("chapter_id", "chunk_id", F.col("text").alias("source")).distinct().join(p, ["chapter_id", "chunk_id"])


def q01_paragraph_tokens(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.length("line").alias("chars"), T.estimated_tokens("line").alias("tokens"))


def q02_greedy_chunks(spark, sf):
    ship_package(spark)
    chapters = structure.split_by_headings(structure.paragraph_rows(table(spark, sf, "paragraphs")))
    packed = chunking.pack(chapters, PACK_LIMIT)
    return packed.select("doc_id", F.col("chapter_no").cast("int").alias("chapter_no"), "chunk_no", F.size("paragraph_ids").alias("n_paragraphs"), "estimated_tokens", F.md5("text").alias("text_md5"))


def q03_chunk_totals(spark, sf):
    return table(spark, sf, "chunks").groupBy("chapter_id").agg(F.count_distinct("chunk_id").alias("total"))


def q04_keep_source(spark, sf):
    rows = _chunks(spark, sf).where("text is not null")
    return rows.where(T.keeps_source("text")).select("chapter_id", "chunk_id", T.strip("text").rlike(r"(?i)^(https?://|www\.)\S+$").alias("is_url"))


def q05_chapter_status(spark, sf):
    return progress.chapter_status(table(spark, sf, "chunks"), table(spark, sf, "progress"))


def q05_status_summary(spark, sf):
    return progress.summary(q05_chapter_status(spark, sf), table(spark, sf, "progress"))


def q06_chapter_stats(spark, sf):
    return stats.chapter_stats(table(spark, sf, "processed_chunks"))


def q06_run_summary(spark, sf):
    return stats.run_summary(q06_chapter_stats(spark, sf))


def q07_completion(spark, sf):
    return stats.completion(table(spark, sf, "processed_chunks"))


def q08_latest_state(spark, sf):
    return progress.latest_state(table(spark, sf, "progress"))


def q09_usage(spark, sf):
    return progress.usage(table(spark, sf, "events"), "ts", "event_type").withColumn("day", F.col("day").cast("string"))


def q10_heading_chapters(spark, sf):
    rows = structure.split_by_headings(structure.paragraph_rows(table(spark, sf, "paragraphs")))
    return rows.groupBy("doc_id", "chapter_no").agg(F.first("title").alias("title"), F.count("*").alias("n_paragraphs"), F.min("pos").alias("start"))


def q11_glossary_sections(spark, sf):
    rows = table(spark, sf, "glossary").select("line_no", "section", "term")
    return prefix.forward_fill(rows, [], "line_no", "section", "filled", prefix.BLOCK).select("line_no", "filled", "term")


def q12_first_wins(spark, sf):
    return entities.first_wins(table(spark, sf, "mentions")).select("name_key", "mention_id", "text")


def q12_first_wins_in_paragraph(spark, sf):
    return entities.first_wins(table(spark, sf, "mentions"), "source_paragraph_id").select("name_key", "source_paragraph_id", "mention_id")


def _pruned(spark, sf):
    rows = table(spark, sf, "mentions").select(F.col("mention_id").alias("ord"), F.col("text").alias("name"), F.coalesce("entity_type", F.lit("lainnya")).alias("kind")).distinct()
    return glossary.prune_variants(rows)


def q13_prune_variants(spark, sf):
    return _pruned(spark, sf)


def q14_not_contained(spark, sf):
    return glossary.not_contained(_pruned(spark, sf))


def q15_valid_mentions(spark, sf):
    ids = table(spark, sf, "paragraphs").select(F.col("paragraph_id").alias("source_paragraph_id")).distinct()
    rows = entities.normal_mentions(table(spark, sf, "mentions")).join(ids, "source_paragraph_id", "left_semi")
    return rows.select("mention_id", "text", "entity_type", "confidence", "source_paragraph_id")


def q16_completeness(spark, sf):
    expected = table(spark, sf, "chunks").select(F.explode("paragraph_ids").alias("paragraph_id"))
    return assemble.completeness(expected, table(spark, sf, "assembled_paragraphs"))


def q16_chunk_paragraphs(spark, sf):
    rows = assemble.chunk_paragraphs(table(spark, sf, "chunks"), table(spark, sf, "processed_chunks"))
    return rows.groupBy("chapter_id", "chunk_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("paragraph_id").isNull()).alias("unexpected"), F.count_if(F.col("translated").isNull()).alias("missing"))


def q17_translated_or_original(spark, sf):
    rows = assemble.translated_or_original(table(spark, sf, "paragraphs"), table(spark, sf, "assembled_paragraphs"))
    return rows.select("paragraph_id", F.md5("text").alias("text_md5"), "translated")


def q18_glossary_aliases(spark, sf):
    return glossary.resolve_aliases(table(spark, sf, "glossary"))


def q18_name_index(spark, sf):
    return entities.name_index(table(spark, sf, "entities"))


def _checked(spark, sf):
    return qa.check(_pairs(spark, sf)).select("chapter_id", "chunk_id", "passed", F.posexplode_outer("found_issues").alias("n", "i"))


def q19_qa_issues(spark, sf):
    rows = _checked(spark, sf).where("i is not null")
    return rows.groupBy("chapter_id", "chunk_id", F.col("i.rule").alias("rule")).agg(F.count("*").alias("n"))


def q19_qa_passed(spark, sf):
    return qa.check(_pairs(spark, sf)).groupBy("passed").agg(F.count("*").alias("n"))


def q20_untranslated_english(spark, sf):
    rows = table(spark, sf, "assembled_paragraphs").select("paragraph_id", "translated_text").distinct()
    return rows.where(qa.english_sentence(F.col("translated_text"))).select("paragraph_id")


def q22_preserved_entities(spark, sf):
    names = entities.normal_mentions(table(spark, sf, "mentions")).groupBy(F.col("source_paragraph_id").alias("paragraph_id")).agg(F.array_sort(F.collect_set("text")).alias("names"))
    source = _paragraphs(spark, sf).select("paragraph_id", F.col("text").alias("source"))
    target = table(spark, sf, "assembled_paragraphs").select("paragraph_id", "translated_text").distinct()
    rows = source.join(names, "paragraph_id").join(target, "paragraph_id")
    found = F.filter(qa.issues(F.col("source"), F.col("translated_text"), F.col("names")), lambda i: i["rule"] == "preserved_entity")
    return rows.select("paragraph_id", F.explode(found).alias("i")).select("paragraph_id", F.col("i.message").alias("message"))


def q23_evidence(spark, sf):
    return entities.evidence(table(spark, sf, "entities")).select("entity_id", "n", "score", "valid")


def q24_search_queries(spark, sf):
    e = table(spark, sf, "entities")
    return e.select("entity_id", entities.search_query(F.col("canonical_name"), F.col("entity_type"), F.lit("The Novel"), F.lit("An Author"), attempt=2).alias("query"))


def q25_glossary_replaced(spark, sf):
    ship_package(spark)
    rows = table(spark, sf, "assembled_paragraphs").select("paragraph_id", "translated_text").distinct()
    return glossary.replace_terms(rows, "translated_text", glossary.resolve_aliases(table(spark, sf, "glossary"))).select("paragraph_id", "replaced")


def q27_spine_classes(spark, sf):
    return structure.classify_spine(_paragraphs(spark, sf))


def q28_spine_chapters(spark, sf):
    return structure.split_by_spine(_paragraphs(spark, sf))


def q29_story_flags(spark, sf):
    rows = q10_heading_chapters(spark, sf).select("doc_id", "chapter_no", "title")
    return structure.story_flags(rows, F.col("doc_id")).select("doc_id", "chapter_no", "title", "is_matter")


def q30_distributed_runs(spark, sf):
    runs = table(spark, sf, "paragraphs").select("paragraph_id", F.transform("runs", lambda r: F.length(F.coalesce(r["text"], F.lit(""))).cast("bigint")).alias("lengths")).where("size(lengths) > 0").distinct()
    texts = table(spark, sf, "assembled_paragraphs").where("translated_text is not null").groupBy("paragraph_id").agg(F.max("translated_text").alias("t"))
    rows = runs.join(texts, "paragraph_id").select("paragraph_id", F.posexplode(assemble.distribute(F.col("t"), F.col("lengths"))).alias("run_no", "part"))
    return rows.select("paragraph_id", "run_no", F.length("part").alias("chars"), F.md5("part").alias("part_md5"))


def q31_chapter_bounds(spark, sf):
    p = _paragraphs(spark, sf)
    starts = p.where("heading_level is not null").select("doc_id", F.col("pos").alias("start")).distinct()
    return structure.chapter_bounds(starts, p.groupBy("doc_id").agg((F.max("pos") + 1).alias("n_paragraphs")))


def q32_sessions(spark, sf):
    rows = structure.sessions(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "error")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def q33_cache_probe(spark, sf):
    key = lambda: progress.cache_key(F.col("text"), F.array_join("paragraph_texts", "\n"), F.lit("model"))
    chunks = _chunks(spark, sf).withColumn("key", key())
    done = table(spark, sf, "processed_chunks").where("qa_passed").select("chapter_id", "chunk_id", "translation").distinct()
    cache = chunks.join(done, ["chapter_id", "chunk_id"]).select("key", F.lit(1).alias("cache_version"), F.lit("passed").alias("status"), "translation")
    return progress.probe_cache(chunks, cache).select("chapter_id", "chunk_id", "key", "hit")


def q34_name_forms(spark, sf):
    rows = table(spark, sf, "mentions").select("text").distinct().where("text is not null")
    return rows.select("text", T.normal_name("text").alias("name_key"), T.squash("text").alias("squashed"), F.array_join(T.core_words("text"), " ").alias("core"), T.display_name("text").alias("display"))


def q35_ranges(spark, sf):
    rows = spark.createDataFrame([("2,5,7-8",), ("3",), ("2-5",), ("5-2",), ("a",), ("1, 1 ,2-3",), ("",)], "value string")
    return rows.select("value", F.array_join(structure.parse_ranges(F.col("value")), ",").alias("numbers"))


def q36_repeated_ids(spark, sf):
    return assemble.repeated_keys(table(spark, sf, "paragraphs"), "paragraph_id")


def q37_newest_events(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return prefix.newest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type", "rank")


def q38_json_fields(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(T.unfenced_json(fenced), "$.k").cast("int").alias("k"))


def q39_title_errors(spark, sf):
    source = _paragraphs(spark, sf).where("heading_level is not null").select("paragraph_id", F.col("text").alias("title"))
    target = table(spark, sf, "assembled_paragraphs").where("translated_text is not null").groupBy("paragraph_id").agg(F.max("translated_text").alias("t"))
    return source.join(target, "paragraph_id").select("paragraph_id", T.title_error(F.col("title"), F.col("t")).alias("error"), T.label_title(F.col("title")).alias("label"))


def q40_paths(spark, sf):
    urls = table(spark, sf, "entities").select(F.explode("research.url").alias("url")).distinct()
    return urls.select("url", T.resolved_path(F.lit("OEBPS/./text"), F.concat(F.lit("../"), F.regexp_replace("url", "^https?://", ""))).alias("path"))


def q41_output_gate(spark, sf):
    per = q05_chapter_status(spark, sf)
    return per.agg(F.count_if(F.col("status") != "completed").alias("failed"), F.sum("flagged").cast("bigint").alias("flagged")).withColumn("blocked", progress.output_blocked(F.col("failed"), F.col("flagged")))


def q42_resolved_mentions(spark, sf):
    firsts = entities.first_wins(entities.normal_mentions(table(spark, sf, "mentions")))
    return entities.resolve_mentions(firsts, table(spark, sf, "entities")).select("mention_id", "text", "entity_id", "status")


def q42_resolution_stats(spark, sf):
    return stats.resolution_stats(q42_resolved_mentions(spark, sf))


def q43_merged_chapters(spark, sf):
    rows = table(spark, sf, "processed_chunks").select("chapter_id", "chunk_id", "translation", "paragraph_translations", "attempts", "qa_passed", "flagged").distinct()
    merged = stats.merge_split(rows, ["chapter_id"], "chunk_id")
    return merged.select("chapter_id", F.md5("translation").alias("text_md5"), F.size("paragraph_translations").alias("n"), "attempts", "qa_passed", "flagged")


def q44_glossary_stats(spark, sf):
    return stats.glossary_stats(table(spark, sf, "glossary"))


def q45_names_by_kind(spark, sf):
    return glossary.grouped_by_kind(_pruned(spark, sf)).select("kind", F.size("names").alias("n"), F.element_at("names", 1).alias("first_name"))


def q46_new_terms(spark, sf):
    return glossary.new_terms(_pruned(spark, sf), table(spark, sf, "glossary")).select("core", "name", "kind")


def q47_term_meanings(spark, sf):
    rows = entities.term_meanings(_pruned(spark, sf), table(spark, sf, "entities"))
    return rows.select("name", "meaning", F.coalesce(F.size("snippets"), F.lit(0)).alias("n_snippets"))


def q48_pending_chunks(spark, sf):
    return progress.pending(table(spark, sf, "chunks"), table(spark, sf, "progress"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}
