"""Splitting oversized items at natural boundaries, by agglomerative merging.

Each oversized text is taken apart into atomic segments (words with the white space after them, and where no spaces are written what
stands between the marks that end sentences and clauses; one too long for a piece is cut by characters, never before a combining
mark). All adjacent pairs stand in a heap ordered by the strength of the boundary between them (inside a word,
word, clause, sentence, paragraph) and then by their combined size, and are merged weakest first while the combined size plus
the overlap fits the limit. What cannot merge any more becomes the pieces, in order; each but the first is preceded by the end
of the one before, from a word start at most the overlap back.

Sizes are estimates in tokens, a quarter of the code points rounded up, whatever a stored estimate says. Items within the limit
never reach Python: they come out whole, as one piece, from the JVM.

Defined results: null and empty texts and runs have no piece; null elements of runs count as empty; a blank text above the limit
is split like any other; repeated rows of an item give its pieces once; an item kind without a row in the limits is never split;
an overlap of half the limit or more counts as half the limit; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLOSERS = "\"'”’»)]}」』）】〉》"
_ATOM = re.compile(rf"\s*(?:[^\s。！？、，；：]+(?:[。！？、，；：]+[{re.escape(_CLOSERS)}]*)?|[。！？、，；：]+[{re.escape(_CLOSERS)}]*)\s*|\s+")
_PARAGRAPH, _SENTENCE, _CLAUSE, _WORD, _INSIDE = 4, 3, 2, 1, 0

#: Kinds of items up to which the limits go to every executor; more are joined by shuffle.
MOST_KINDS = 1000

PIECES = "item_kind string, item_id string, piece_no int, n_pieces int, start int, overlap_chars int, estimated_tokens int, text string"


def _strength(before: str) -> int:
    """How natural a cut after this atom is."""
    word = before.rstrip()
    if "\n" in before[len(word) :] or "\r" in before[len(word) :]:
        return _PARAGRAPH
    core = word.rstrip(_CLOSERS)
    if core[-1:] and core[-1] in ".!?…。！？":
        return _SENTENCE
    if len(word) == len(before):
        return _INSIDE
    return _CLAUSE if word[-1:] and word[-1] in ",;:—、，；：" else _WORD


def _character_end(text: str, start: int, end: int) -> int:
    """The last place up to `end` where no combining mark, joiner or variation selector follows; `end` itself if there is none after start."""
    at = end
    while at > start + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "\u200c\u200d\ufe0e\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return at if at > start + 1 or end == start + 1 else end


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, core start, end): a piece is text[start:end], its overlap text[start:core start]."""
    limit = 4 * max_tokens
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    overlap = max(0, min(4 * overlap_tokens, limit // 2))
    room = limit - overlap
    ends: list[int] = []
    at = 0
    for m in _ATOM.finditer(text):
        while m.end() - at > room:
            at = _character_end(text, at, at + room)
            ends.append(at)
        if m.end() > at:
            ends.append(m.end())
            at = m.end()
    n = len(ends)
    starts = [0, *ends[:-1]]
    strength = [_strength(text[starts[i] : ends[i]]) for i in range(n - 1)]
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - starts[i], i, ends[i], ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, middle, end = heapq.heappop(heap)
        if not alive[i] or ends[i] != middle or right[i] >= n or ends[right[i]] != end or starts[i] != end - size:
            continue  # one of the two was merged since; the pair that it became stands in the heap itself
        if size + overlap > limit:
            continue  # sizes only grow, so it will never fit
        j = right[i]
        ends[i], alive[j], right[i] = ends[j], False, right[j]
        strength[i] = strength[j] if j < n - 1 else 0
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], ends[right[i]] - starts[i], i, ends[i], ends[right[i]]))
        if left[i] >= 0:
            h = left[i]
            heapq.heappush(heap, (strength[h], ends[i] - starts[h], h, ends[h], ends[i]))
    cores = [(starts[i], ends[i]) for i in range(n) if alive[i]]
    out = [(cores[0][0], *cores[0])]
    for (before, _), (start, end) in zip(cores, cores[1:]):
        back = max(before, start - overlap)
        if back > before and not (text[back - 1].isspace() and not text[back].isspace()):
            m = re.compile(r"\s(?=\S)").search(text, back, start)
            back = m.end() if m and m.end() < start else back
        out.append((back, start, end))
    return out


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of items (item_kind, item_id, text) under limits (item_kind, max_tokens, overlap_tokens).

    `limits` has one row a kind. Columns of the result: item_kind, item_id, piece_no (from 0), n_pieces, start (of the piece's own
    part in the item), overlap_chars (repeated from the piece before), estimated_tokens, text.
    """
    bound = limits.groupBy("item_kind").agg(F.min("max_tokens").alias("max_tokens"), F.max("overlap_tokens").alias("overlap_tokens"))
    if bound.limit(MOST_KINDS + 1).count() <= MOST_KINDS:
        bound = F.broadcast(bound)
    rows = items.select("item_kind", "item_id", "text").where(F.length("text") > 0).join(bound, "item_kind", "left")
    size = F.ceil(F.length("text") / F.lit(4)).cast("int")
    over = F.coalesce(size > F.col("max_tokens"), F.lit(False))
    whole = rows.where(~over).dropDuplicates(["item_kind", "item_id", "text"]).select(
        "item_kind", "item_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"),
        F.lit(0).alias("overlap_chars"), size.alias("estimated_tokens"), "text",
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, item, text, most, overlap in b.itertuples(index=False):
                cut = split_text(text, int(most), int(overlap) if overlap == overlap and overlap is not None else 0)
                out += [(kind, item, k, len(cut), core, core - at, -((at - end) // 4), text[at:end]) for k, (at, core, end) in enumerate(cut)]
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "piece_no", "n_pieces", "start", "overlap_chars", "estimated_tokens", "text"])

    cut = rows.where(over).dropDuplicates(["item_kind", "item_id", "text"]).select("item_kind", "item_id", "text", "max_tokens", "overlap_tokens")
    return whole.unionByName(cut.mapInPandas(pieces, PIECES))


def chunk_items(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk").alias("item_kind"), F.concat("chapter_id", F.lit("/"), "chunk_id").alias("item_id"), "text")


def paragraph_items(paragraphs: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    return paragraphs.select(F.lit("paragraph").alias("item_kind"), F.col("paragraph_id").alias("item_id"), joined.alias("text"))


def oversized(pieces: DataFrame) -> DataFrame:
    """Items that came out of split_items in more than one piece."""
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("item_kind", "item_id").distinct()
