"""Counters of translation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNTERS = ("chunks", "completed", "flagged", "cache_hits", "attempts", "retries", "issues")


def chapter_stats(processed: DataFrame) -> DataFrame:
    """Counters of each chapter and, in the row without chapter, of the run; attempts and retries count for cache misses only."""
    rows = processed.select("chapter_id", "chunk_id", "attempts", "qa_passed", "flagged", "cache_hit", F.coalesce(F.size("issues"), F.lit(0)).alias("n_issues")).distinct()
    miss = ~F.coalesce("cache_hit", F.lit(False))
    a = F.coalesce("attempts", F.lit(0))
    return rows.rollup("chapter_id").agg(
        F.count("*").alias("chunks"), F.count_if("qa_passed").alias("completed"), F.count_if("flagged").alias("flagged"), F.count_if("cache_hit").alias("cache_hits"),
        F.sum(F.when(miss, a).otherwise(0)).cast("bigint").alias("attempts"), F.sum(F.when(miss, F.greatest(a - 1, F.lit(0))).otherwise(0)).cast("bigint").alias("retries"),
        F.sum(F.greatest("n_issues", F.lit(0))).cast("bigint").alias("issues"))


def run_counters(paragraphs: DataFrame, processed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Counters of each chapter and, in the row without chapter, of the run, with paragraphs (chapter_id, paragraph_id), entities and
    failed research (chapter_id, status). Each side is counted by itself before they meet, so none multiplies another."""
    p = paragraphs.select("chapter_id", "paragraph_id").distinct().rollup("chapter_id").agg(F.count("*").alias("paragraphs"))
    e = resolved.rollup("chapter_id").agg(F.count("*").alias("entities"), F.count_if(F.lower("status") == "research_failed").alias("research_failed"))
    sides = [x.withColumn("k", F.coalesce("chapter_id", F.lit("\x00"))).drop("chapter_id") for x in (chapter_stats(processed), p, e)]
    rows = sides[0].join(sides[1], "k", "full_outer").join(sides[2], "k", "full_outer")
    return rows.select(F.when(F.col("k") != "\x00", F.col("k")).alias("chapter_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*_COUNTERS, "paragraphs", "entities", "research_failed")])


def run_summary(stats: DataFrame) -> DataFrame:
    """The run's row, with the share of chunks that passed in percent, ties to even."""
    total = stats.where("chapter_id is null")
    return total.select(*_COUNTERS, F.bround(100 * F.col("completed") / F.col("chunks"), 0).cast("int").alias("percent"))


def completion(processed: DataFrame) -> DataFrame:
    """(chapter_id, complete): whether a chapter has chunks and all passed."""
    return processed.groupBy("chapter_id").agg(((F.count("*") > 0) & F.bool_and(F.coalesce("qa_passed", F.lit(False)))).alias("complete"))


def merge_split(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The parts a failed chunk was halved into as one again: texts and arrays in order, attempts added, passed if all, flagged if any."""
    x = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("translation", F.lit("")).alias("t"), F.coalesce("paragraph_translations", F.array().cast("array<string>")).alias("p"))))
    return parts.groupBy(*keys).agg(
        x.alias("x"), F.sum(F.coalesce("attempts", F.lit(0))).cast("bigint").alias("attempts"), F.bool_and(F.coalesce("qa_passed", F.lit(False))).alias("qa_passed"), F.bool_or(F.coalesce("flagged", F.lit(False))).alias("flagged")
    ).select(*keys, F.array_join(F.transform("x", lambda v: v["t"]), "\n").alias("translation"), F.flatten(F.transform("x", lambda v: v["p"])).alias("paragraph_translations"), "attempts", "qa_passed", "flagged")


def glossary_stats(glossary: DataFrame) -> DataFrame:
    return glossary.agg(
        F.count("*").alias("total"), F.count_if(F.trim(F.coalesce("meaning", F.lit(""))) == "").alias("empty"), F.count_if(~F.coalesce("active", F.lit(True))).alias("disabled"), F.count_if(F.coalesce("is_alias", F.lit(False))).alias("aliases"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("mentions"), F.count_distinct("entity_id").alias("entities"))
