"""Reassembly of translated paragraphs, with completeness checks, and distribution of a translation over formatted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_paragraphs(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """(chapter_id, chunk_id, k, paragraph_id, translated): translations on their paragraph ids.

    A chunk of one paragraph takes `translation`, others the paragraph translations, by position; positions without a partner have a null.
    """
    a = chunks.select("chapter_id", "chunk_id", "paragraph_ids").distinct()
    b = processed.select("chapter_id", "chunk_id", "translation", "paragraph_translations").distinct()
    rows = a.join(b, ["chapter_id", "chunk_id"])
    texts = F.when(F.size("paragraph_ids") == 1, F.array("translation")).otherwise(F.coalesce("paragraph_translations", F.array().cast("array<string>")))
    zipped = F.arrays_zip(F.col("paragraph_ids").alias("i"), texts.alias("t"))
    return rows.select("chapter_id", "chunk_id", F.posexplode(zipped).alias("k", "x")).select("chapter_id", "chunk_id", "k", F.col("x.i").alias("paragraph_id"), F.col("x.t").alias("translated"))


def completeness(expected: DataFrame, actual: DataFrame, key: str = "paragraph_id") -> DataFrame:
    """(key, side): keys that only one side has, `missing` from the actual or `unexpected` in it."""
    a, b = expected.select(key).distinct().withColumn("e", F.lit(True)), actual.select(key).distinct().withColumn("a", F.lit(True))
    rows = a.join(b, key, "full_outer")
    return rows.where("e is null or a is null").select(key, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def translated_or_original(paragraphs: DataFrame, assembled: DataFrame) -> DataFrame:
    """(paragraph_id, text, translated): the assembled translation where it has text, else the original."""
    texts = assembled.where(F.trim(F.coalesce("translated_text", F.lit(""))) != "").groupBy("paragraph_id").agg(F.max("translated_text").alias("t"))
    rows = paragraphs.select("paragraph_id", F.coalesce("text", F.lit("")).alias("original")).distinct()
    return rows.join(texts, "paragraph_id", "left").select("paragraph_id", F.coalesce("t", "original").alias("text"), F.col("t").isNotNull().alias("translated"))


def distribute(translated: Column, lengths: Column) -> Column:
    """A translation cut over runs in proportion to their source lengths; bounds round ties to even, the last run takes the rest.

    Without source characters all goes to the first run.
    """
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    n = F.length(translated)
    sums = F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    bound = lambda i: F.when(i == F.size(lengths), n).otherwise(F.bround(n * F.get(sums, i) / total, 0).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: F.substring(translated, bound(i) + 1, F.greatest(bound(i + 1) - bound(i), F.lit(0))))
    first = F.transform(lengths, lambda x, i: F.when(i == 0, translated).otherwise(""))
    return F.when(F.size(lengths) == 0, F.array().cast("array<string>")).when(total == 0, first).otherwise(cut)
