"""Structured Streaming over the logs of translation runs: usage a day and the states of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.progress import latest_state


def usage_per_day(requests: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """Requests per day and key of a stream; a day closes when no row older than `late` is expected any more."""
    days = F.window(ts, "1 day")
    return requests.withWatermark(ts, late).groupBy(days, key).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), key, "n")


def distinct_requests(requests: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """A stream without repeated requests, remembered as long as they may come late."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


#: Buckets of chapters in a table of states; a batch rewrites those it touches.
BUCKETS = 64
_COLUMNS = ["chapter_id", "chunk_id", "status", "qa_passed", "flagged", "saved_at"]


def _versions(spark: SparkSession, table_path: str) -> dict[int, list[tuple[int, str]]]:
    """(epoch, folder) of each bucket of a table of states, in order; only epochs that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(table_path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[tuple[int, str]]] = {}
    for e in fs.listStatus(root) if fs.exists(root) else ():
        name = e.getPath().getName()
        if name.startswith("epoch=") and fs.exists(path(e.getPath(), "_SUCCESS")):
            for b in fs.listStatus(e.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    out.setdefault(int(b.getPath().getName()[7:]), []).append((int(name[6:]), b.getPath().toString()))
    return {b: sorted(v) for b, v in out.items()}


def states(spark: SparkSession, table_path: str) -> DataFrame:
    """The latest states that follow_progress has folded: the newest folder of each bucket."""
    newest = [v[-1][1] for v in _versions(spark, table_path).values()]
    schema = "chapter_id string, chunk_id string, status string, qa_passed boolean, flagged boolean, saved_at timestamp, ever_flagged boolean, n_rows bigint"
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def follow_progress(spark: SparkSession, stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of progress rows into a table of latest states, a batch at a time; a repeated batch changes nothing.

    Chapters lie in BUCKETS by hash. A batch reads and rewrites the buckets it touches only, and what stood in them two batches ago goes.
    """
    def fold(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*_COLUMNS, F.pmod(F.xxhash64("chapter_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).persist()
        try:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            before = {b: [x for x in v if x[0] < epoch] for b, v in _versions(spark, table_path).items() if b in set(touched)}
            paths = [v[-1][1] for v in before.values() if v]
            new = rows
            if paths:
                held = spark.read.parquet(*paths).withColumn("bucket", F.pmod(F.xxhash64("chapter_id"), F.lit(BUCKETS)).cast("int"))
                # a chunk that was ever flagged stays so: the sticky flag rides on a row that any other outranks
                sticky = held.where("ever_flagged").select("chapter_id", "chunk_id", F.lit("not_started").alias("status"), F.lit(None).cast("boolean").alias("qa_passed"), F.lit(True).alias("flagged"), F.lit(None).cast("timestamp").alias("saved_at"), "bucket")
                new = rows.unionByName(held.select(*_COLUMNS, "bucket")).unionByName(sticky)
            folded = latest_state(new.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64("chapter_id"), F.lit(BUCKETS)).cast("int"))
            folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/epoch={epoch:010d}")
            fs = spark._jvm.org.apache.hadoop.fs.Path(table_path).getFileSystem(spark._jsc.hadoopConfiguration())
            for v in before.values():
                for _, old in v[:-1]:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
