"""Encoding of texts with a public byte-level BPE tokenizer, reusing content-defined chunks.

A rolling hash over the last WINDOW characters proposes chunk ends that depend on content alone, so texts that share passages share
chunks wherever the passages stand. A chunk's ids hold only between *seams*: positions between a visible character and a following
blank or newline, where the pre-tokenizer always ends a word, whatever stands around. So each join of two chunks is repaired: the
window around it grows until it ends at a seam, and chunks without a seam are taken into their neighbours. Each distinct repaired
chunk is encoded once per Python worker and kept in a memo of bounded size, and the ids of a text are those of its chunks in a row.
One text in CHECKED is encoded whole as well, and a disagreement fails the job.

The memo is per worker on purpose: a table of chunks for the whole corpus sends every text byte through two shuffles and puts a
chunk that a third of all documents share into one task, to save an encoding that costs less than the shuffle (figures in the README).

Seams are a property of this family of rank files and their pattern; with a tokenizers JSON file each text is encoded whole.

Defined results: a null text and an empty text give an empty array; repeated rows give repeated rows; strings of special tokens
in a text are ordinary text; other columns are dropped; the schema is always (doc_id, ids).
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtools import int_lists, map_batches

#: Characters under the rolling hash, and the bits of it that must be zero at a proposed end: chunks have some 2**CUT_BITS characters.
WINDOW, CUT_BITS = 8, 4
#: Chunks that a worker remembers; when full the memo starts anew, which changes time and never ids.
MEMO_ENTRIES = 200_000
#: Longer chunks are encoded without being remembered, so the memo's bytes are bounded too.
MEMO_CHARS = 512
#: One text in so many is encoded whole as well.
CHECKED = 64


def _visible() -> np.ndarray:
    """By code point: whether a blank or newline behind it always begins a new word of the pre-tokenizer."""
    out = np.zeros(0x110000, bool)
    for a, b in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x3001, 0xD7FF)):
        out[a : b + 1] = True
    return out


_VISIBLE = _visible()


def default_tokenizer() -> str:
    """Path of byte_bpe_50k (as ranks) where the public_tokenizers package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _raw(path: str):
    """A plain encoder of a list of texts: tiktoken for a file of ranks, tokenizers for a JSON file."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(x) for x in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def chunk_ends(texts: list[str], window: int = WINDOW, bits: int = CUT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the repaired chunks in the joined texts, each text's end among them; and the texts' ends."""
    stops = np.cumsum([len(t) for t in texts])
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(c) <= window:
        return np.unique(stops[stops > 0]), stops
    seam = np.zeros(len(c), bool)
    seam[1:] = _VISIBLE[c[:-1]] & ((c[1:] == 32) | (c[1:] == 10))
    starts = np.concatenate([[0], stops[:-1]])
    seam[starts[starts < len(c)]] = False
    seams = np.flatnonzero(seam)
    mixed = c * np.uint32(2654435761) + np.uint32(0x9E3779B9)
    h = np.zeros(len(c) - window + 1, dtype=np.uint32)
    for k in range(window):
        h = h * np.uint32(16777619) + mixed[k : k + len(h)]
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + window
    owner = np.searchsorted(stops, at, side="left")
    owner = np.minimum(owner, len(stops) - 1)
    at, owner = at[inside := at - starts[owner] >= window], owner[inside]  # what stands before a text has no say
    k = np.searchsorted(seams, at)
    at, owner = seams[k[fine := k < len(seams)]], owner[fine]
    return np.unique(np.concatenate([at[at < stops[owner]], stops[stops > 0]])), stops


class ChunkEncoder:
    """Encodes texts by chunks; `raw` is the plain encoder of a list of texts."""

    def __init__(self, raw):
        self.raw, self.memo = raw, {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        texts = [t or "" for t in texts]
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        ends, stops = chunk_ends(texts)
        pieces = [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        new = [p for p in dict.fromkeys(pieces) if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo, new = {}, list(dict.fromkeys(pieces))
        fresh = dict(zip(new, (np.array(x, dtype=np.int32) for x in self.raw(new)))) if new else {}
        self.memo.update(fresh)
        memo = self.memo
        parts = [memo[p] for p in pieces]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        flat = np.concatenate(parts)
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        at = sizes[np.searchsorted(ends, stops, side="right")]
        return flat, np.diff(at, prepend=0)

    def check(self, texts: list[str | None], flat: np.ndarray, lengths: np.ndarray) -> None:
        """Encodes one text in CHECKED, chosen by its hash, whole and compares."""
        stops = np.cumsum(lengths)
        for i, t in enumerate(texts):
            if t and zlib.crc32(t[:64].encode("utf-8", "surrogatepass")) % CHECKED == 0 and self.raw([t])[0] != flat[stops[i] - lengths[i] : stops[i]].tolist():
                raise ValueError("chunked and whole encoding disagree: the tokenizer does not end words at seams")


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(_raw(path))
    return _encoders[path]


def token_ids(docs: DataFrame, tokenizer: str | Path | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row; `tokenizer` is the path of a rank file (.tiktoken) or tokenizers JSON file that every executor can read."""
    path = str(tokenizer or default_tokenizer())

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        if path.endswith(".tiktoken"):
            tool = _encoder(path)
            flat, lengths = tool.encode(texts)
            tool.check(texts, flat, lengths)
        else:
            ids = _raw(path)([t or "" for t in texts])
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.array([i for x in ids for i in x], dtype=np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), int_lists(flat, lengths)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, encode, "doc_id bigint, ids array<int>")
