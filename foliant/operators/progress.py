"""State of translation runs: latest state, sticky flags, chapter status, resuming, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(progress: DataFrame) -> DataFrame:
    """One row a (chapter_id, chunk_id): the state last saved, and whether any state was ever flagged.

    Rows without a time count before all others; of equal times the further status wins, then a passed check.
    """
    stage = F.when(F.col("status") == "completed", 2).when(F.col("status") == "in_progress", 1).otherwise(0)
    order = F.struct(F.coalesce(F.col("saved_at"), F.lit("0001-01-01").cast(progress.schema["saved_at"].dataType)), stage, F.coalesce("qa_passed", F.lit(False)), F.coalesce("flagged", F.lit(False)))
    return progress.groupBy("chapter_id", "chunk_id").agg(
        F.max_by(F.struct("status", "qa_passed", "flagged", "saved_at"), order).alias("s"), F.bool_or(F.coalesce("flagged", F.lit(False))).alias("ever_flagged"), F.count("*").alias("n_rows")
    ).select("chapter_id", "chunk_id", "s.*", "ever_flagged", "n_rows")


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new states with one row a chunk, as latest_state gives it."""
    return latest_state(existing.unionByName(new, allowMissingColumns=True))


def chapter_status(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """(chapter_id, total, done, flagged, status, percent): every chapter of the chunk list, with or without progress."""
    totals = chunks.groupBy("chapter_id").agg(F.count_distinct("chunk_id").alias("total"))
    state = latest_state(progress).groupBy("chapter_id").agg(
        F.count_if(F.col("qa_passed")).alias("done"), F.count_if("ever_flagged").alias("flagged"), F.count_if(F.col("status") != "not_started").alias("begun"))
    rows = totals.join(state, "chapter_id", "left").select("chapter_id", "total", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("done", "flagged", "begun")])
    status = F.when((F.col("total") > 0) & (F.col("done") >= F.col("total")), "completed").when(F.col("begun") > 0, "in_progress").otherwise("not_started")
    return rows.select("chapter_id", "total", "done", "flagged", status.alias("status"), F.bround(100 * F.col("done") / F.col("total"), 0).cast("int").alias("percent"))


def summary(status: DataFrame, progress: DataFrame) -> DataFrame:
    """One row over all chapters: counts, percent with ties to even, and of the chapters in progress the one whose state was saved last
    (of equals the first)."""
    touched = progress.groupBy("chapter_id").agg(F.unix_micros(F.max(F.col("saved_at").cast("timestamp"))).alias("touched"))
    late = F.struct(-F.coalesce("touched", F.lit(0)), "chapter_id")
    return status.join(touched, "chapter_id", "left").agg(
        F.count("*").alias("chapters"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "in_progress").alias("in_progress"),
        F.count_if(F.col("status") == "not_started").alias("not_started"), F.sum("total").cast("bigint").alias("chunks"), F.sum("done").cast("bigint").alias("done"),
        F.sum("flagged").cast("bigint").alias("flagged"), F.bround(100 * F.sum("done") / F.sum("total"), 0).cast("int").alias("percent"),
        F.min_by("chapter_id", F.when((F.col("status") == "in_progress") & (F.col("total") > 0), late)).alias("active"))


def pending(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Chunks that a resumed run has to translate: all but those whose latest state passed."""
    done = latest_state(progress).where(F.coalesce("qa_passed", F.lit(False))).select("chapter_id", "chunk_id")
    return chunks.select("chapter_id", "chunk_id").distinct().join(done, ["chapter_id", "chunk_id"], "left_anti")


def action(selected: Column, status: Column) -> Column:
    """What a run does with a chapter: completed ones are restored, selected ones translated, others skipped."""
    return F.when(status == "completed", "restore").when(selected, "translate").otherwise("skip")


def output_blocked(failed: Column, flagged: Column) -> Column:
    return (failed > 0) | (flagged > 0)


def usage(requests: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Requests per day (in the session's zone) and keys; rows without a time count under a null day."""
    return requests.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.count("*").alias("n"))


def usage_line(requests: DataFrame) -> DataFrame:
    """(day, line): a day's requests by model (day, model, n) in one line, models in order."""
    part = F.concat("model", F.lit(" "), F.col("n").cast("string"), F.lit("x"))
    return requests.groupBy("day").agg(F.array_join(F.sort_array(F.collect_list(part)), " · ").alias("line"))


def next_chunk(status: DataFrame) -> DataFrame:
    """(chapter_id, line): `chunk n/total` of the chapters in progress."""
    return status.where((F.col("status") == "in_progress") & (F.col("total") > 0)).select(
        "chapter_id", F.format_string("chunk %d/%d", F.least(F.col("done") + 1, F.col("total")), F.col("total")).alias("line"))


def cache_key(*parts: Column) -> Column:
    """sha256 of one canonical string of all parts; a null differs from an empty text, and no part runs into the next."""
    text = [F.when(p.isNull(), "~").otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *text), 256)


def probe_cache(chunks: DataFrame, cache: DataFrame, version: int = 1) -> DataFrame:
    """Chunks (with key) and their cached translation; entries of another version, not passed or without text are misses."""
    good = cache.where((F.col("cache_version") == version) & (F.col("status") == "passed") & (F.trim("translation") != "")).groupBy("key").agg(F.max("translation").alias("cached"))
    return chunks.join(good, "key", "left").withColumn("hit", F.col("cached").isNotNull())


def failure_reasons(log: DataFrame, order: str = "line_no", line: str = "line", cut_at: int = 200) -> DataFrame:
    """(chapter, reason): the last line with a warning or failure below each chapter's header, `[n/m] Chapter: title`, in a log."""
    from foliant.operators.prefix import BLOCK, forward_fill

    head = F.regexp_extract(line, r"^\s*\[\d+/\d+\] Chapter: (.+)$", 1)
    rows = forward_fill(log.withColumn("__h", F.when(head != "", F.trim(head))), [], order, "__h", "chapter", BLOCK)
    bad = rows.where(F.col("chapter").isNotNull() & (F.col(line).contains("WARNING") | F.lower(line).contains("gagal")))
    return bad.groupBy("chapter").agg(F.substring(F.trim(F.max_by(line, order)), 1, cut_at).alias("reason"))
