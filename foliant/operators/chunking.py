"""Greedy packing of ordered paragraphs into chunks of a bounded size.

Packing is a fold: where a chunk begins depends on all before it in its chapter. Rows are partitioned by chapter and sorted inside
partitions, and one pass over Arrow batches carries the open chunk only, so a chapter of any length needs the memory of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = "doc_id string, chapter_no bigint, chunk_no int, paragraph_ids array<string>, paragraph_texts array<string>, text string, estimated_tokens int"


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def word_pieces(text: str, limit: int) -> list[str]:
    """A long paragraph by words, packed greedily; white space collapses, a word above the limit stands alone, a blank text is one piece."""
    out: list[str] = []
    now = ""
    for w in text.split():
        longer = f"{now} {w}" if now else w
        if now and tokens(longer) > limit:
            out.append(now)
            now = w
        else:
            now = longer
    return [*out, now] if now or not out else out


class Packer:
    """The fold of one chapter: feed() takes the next paragraph, end() closes; both give finished chunks (ids, texts, tokens)."""

    def __init__(self, limit: int):
        self.limit, self.ids, self.texts, self.size = limit, [], [], 0

    def end(self) -> list[tuple[list[str], list[str], int]]:
        if not self.ids:
            return []
        done = (self.ids, self.texts, -(-self.size // 4))
        self.ids, self.texts, self.size = [], [], 0
        return [done]

    def feed(self, pid: str, text: str) -> list[tuple[list[str], list[str], int]]:
        if text == "":
            return [*self.end(), ([pid], [""], 0)]
        if tokens(text) > self.limit:
            return [*self.end(), *(([pid], [p], tokens(p)) for p in word_pieces(text, self.limit))]
        out = []
        grown = self.size + 1 + len(text) if self.ids else len(text)
        if self.ids and -(-grown // 4) > self.limit:
            out, grown = self.end(), len(text)
        self.ids.append(pid)
        self.texts.append(text)
        self.size = grown
        return out


def pack(paragraphs: DataFrame, limit: int = 1200) -> DataFrame:
    """Chunks of paragraphs (doc_id, chapter_no, pos, paragraph_id, text); null texts count as empty."""
    rows = paragraphs.select("doc_id", F.col("chapter_no").cast("bigint").alias("chapter_no"), "pos", "paragraph_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("doc_id", "chapter_no").sortWithinPartitions("doc_id", "chapter_no", "pos", "paragraph_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, packer, out = None, 0, Packer(limit), []
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32())

        def emit(done: list) -> None:
            nonlocal n
            for ids, texts, size in done:
                out.append((*key, n, ids, texts, "\n".join(texts), size))
                n += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return b

        for b in batches:
            for doc, chapter, pid, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (doc, chapter) != key:
                    if key is not None:
                        emit(packer.end())
                    key, n = (doc, chapter), 0
                emit(packer.feed(pid, text))
            if out:
                yield batch()
        if key is not None:
            emit(packer.end())
        if out:
            yield batch()

    return rows.mapInArrow(run, CHUNKS)
