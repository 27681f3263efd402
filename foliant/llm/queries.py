"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import align, canonical, encode, encoding, langid, leak, names, pairs, split
from foliant.llm.arrowtools import spread
from foliant.session import ship_package, table, width


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    items = split.chunk_items(table(spark, sf, "chunks")).unionByName(split.paragraph_items(table(spark, sf, "paragraphs")))
    return split.split_items(items, table(spark, sf, "split_limits"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.oversized(p1_pieces(spark, sf))


def _languages(spark: SparkSession, sf: str):
    return langid.fit(table(spark, sf, "documents"))


def _translations(spark: SparkSession, sf: str) -> DataFrame:
    return langid.translation_items(table(spark, sf, "processed_chunks"), table(spark, sf, "assembled_paragraphs"))


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return pairs.defects(table(spark, sf, "chunks"), table(spark, sf, "processed_chunks"), _languages(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_flags(spark, sf).select("chapter_id", "chunk_id", "defect")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return langid.mislabelled(langid.text_languages(_translations(spark, sf), _languages(spark, sf)))


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return langid.text_segments(_translations(spark, sf), _languages(spark, sf))


def _runs_and_terms(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.run_texts(table(spark, sf, "paragraphs")).unionByName(canonical.term_texts(table(spark, sf, "glossary")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return canonical.changed_ids(_runs_and_terms(spark, sf), "text", "item_kind", "item_id", "run_no")


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return canonical.canonical_texts(_runs_and_terms(spark, sf), "text", "item_kind", "item_id", "run_no")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return align.aligned(table(spark, sf, "chunks"), table(spark, sf, "processed_chunks"), _languages(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return names.same_entities(table(spark, sf, "entities"), table(spark, sf, "mentions"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return encode.token_ids(spread(table(spark, sf, "documents").select("doc_id", "text"), width(spark)))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return leak.leaks(spread(table(spark, sf, "documents").select("doc_id", "text"), width(spark)), table(spark, sf, "eval_items"))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return encoding.damaged_spans(spread(table(spark, sf, "documents").select("doc_id", "text"), width(spark)))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_flags": p2_flags, "p3_found": p3_found, "p3_segments": p3_segments, "p4_found": p4_found, "p4_texts": p4_texts, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_restored": p9_restored}
