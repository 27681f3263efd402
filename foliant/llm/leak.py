"""Evaluation texts that leaked into documents, by greedy string tiling.

Both sides become words: lower case, without marks and punctuation; scripts without spaces give one word a character. Runs of SEED
words that a document shares with an item join the two through a sorted index of the items' runs. A pair is followed up unless the
item's words that its seeds in one stretch of the document have, with all gaps between them that may count, are too few: a bound that
no case can miss. Then running Karp-Rabin matching repeatedly marks the longest common runs that do not overlap, whatever their
order, and the pair counts when the runs that lie together in the document cover at least COVERAGE of the item's words (a changed word
between two runs counts as covered, as long as LIGHT of the words are kept).

The items' index is sent to the executors in blocks of at most INDEX_LIMIT bytes of text, as an index takes several times its text;
each block is one pass over the documents, so more items cost passes and never memory. Documents are not shuffled, and no pair within a group is emitted.

Defined results: null and empty documents and items, and items of MIN_WORDS words or fewer, are in no pair; repeated rows and
several passages of one item in a document give one row; a document that quotes MIN_WORDS words or fewer is no case.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtools import map_batches
from foliant.llm.folding import without_marks
from foliant.session import BROADCAST_LIMIT

SEED, MIN_WORDS, COVERAGE, GAP = 3, 5, 0.39, 4
#: Bytes of item text in one index.
INDEX_LIMIT = BROADCAST_LIMIT // 8
#: Share of a passage's words that light edits keep.
LIGHT = 0.75
#: Words of a block that may stand out of order with as many edits as LIGHT allows; a shorter one has at most one edit in DENSE words.
LONG, DENSE = 14, 12
#: Words from one seed to the next: at most in a document within one stretch, where chains end up to two words past their tiles' ends and an edit
#: further; and as many as may count in an item, where a gap counts up to GAP words and a chain's end up to SEED words past its tile.
APART, WITHIN = SEED + 2 * GAP + 2 * SEED, SEED + max(GAP, 2 * SEED)

_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[^\W_\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")
def words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(without_marks(text).lower())


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word arrays: (start in a, start in b, length) of the marked runs."""
    x, y = a.tolist(), b.tolist()
    out: list[tuple[int, int, int]] = []
    # words outside runs of `least` that both sides have are in no tile, and no tile is longer than such runs in a row
    in_x, in_y = list(zip(*[x[k:] for k in range(least)])), list(zip(*[y[k:] for k in range(least)]))
    common = set(in_x) & set(in_y)
    if not common:
        return out
    free_a, free_b = bytearray(len(x)), bytearray(len(y))
    longest_a = row = 0
    for i, w in enumerate(in_x):
        row = row + 1 if w in common else 0
        if row:
            free_a[i : i + least] = b"\1" * least
            longest_a = max(longest_a, row + least - 1)
    for j, w in enumerate(in_y):
        if w in common:
            free_b[j : j + least] = b"\1" * least

    def windows(v: list[int], free: bytearray, s: int):
        """(start, rolling hash) of each run of s free words."""
        base, mod = 1_000_003, (1 << 61) - 1
        top, at, run = pow(base, s, mod), 0, b"\1" * s
        while (at := free.find(run, at)) >= 0:
            end = free.find(0, at)
            end = len(v) if end < 0 else end
            h = 0
            for w in v[at : at + s]:
                h = (h * base + w + 1) % mod
            yield at, h
            for i in range(at + s, end):
                h = (h * base + v[i] + 1 - (v[i - s] + 1) * top) % mod
                yield i - s + 1, h
            at = end

    s = max(least, min(len(x), len(y)) // 2)
    while True:
        if s > longest_a and s > least:
            s = s // 2 if s > 2 * least else least
            continue
        table = defaultdict(list)
        for j, h in windows(y, free_b, s):
            table[h].append(j)
        found, longest = [], 0
        for i, h in windows(x, free_a, s) if table else ():
            for j in table.get(h, ()):
                if x[i : i + s] != y[j : j + s]:
                    continue
                k, most = s, min(len(x) - i, len(y) - j)
                while k < most and x[i + k] == y[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                found.append((k, i, j))
                longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        for k, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if 0 not in free_a[i : i + k] and 0 not in free_b[j : j + k]:
                out.append((i, j, k))
                free_a[i : i + k] = free_b[j : j + k] = bytes(k)
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        else:
            return out


def beyond(x: list[int], y: list[int], i: int, j: int, step: int) -> tuple[int, int, int]:
    """(words of x, words of y, equal words) past an end of a chain: one changed, inserted or dropped word and the one or two equal ones behind it."""
    best = (0, 0, 0)
    for dx, dy in ((1, 1), (1, 0), (0, 1)):
        n = 0
        while n < SEED - 1 and 0 <= (u := i + step * (dx + n)) < len(x) and 0 <= (v := j + step * (dy + n)) < len(y) and x[u] == y[v]:
            n += 1
        if n > best[2]:
            best = (dx + n, dy + n, n)
    return best


def stretches(chain: list[tuple[int, int, int]], x: list[int], y: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(start in x, end in x, start in y, end in y, equal words) of the parts of a chain of tiles that are lightly edited quotes, the longest first."""
    kept = [0]
    for *_, k in chain:
        kept.append(kept[-1] + k)
    before, after = [beyond(x, y, i - 1, j - 1, -1) for i, j, _ in chain], [beyond(x, y, i + k, j + k, 1) for i, j, k in chain]
    out, todo = [], [(0, len(chain))]
    while todo:
        lo, hi = todo.pop()
        best, part = None, None
        for p in range(lo, hi):
            i, j, _ = chain[p]
            for q in range(hi - 1, p - 1, -1):
                i2, j2, k2 = chain[q]
                if best is not None and j2 + k2 - j + 2 * SEED <= best[3] - best[2]:
                    break  # shorter than the best even with both its ends
                for f in {before[p], (0, 0, 0)}:
                    for g in {after[q], (0, 0, 0)}:
                        at = (i - f[0], i2 + k2 + g[0], j - f[1], j2 + k2 + g[1])
                        n, equal = at[3] - at[2], kept[q + 1] - kept[p] + f[2] + g[2]
                        if equal >= LIGHT * max(n, at[1] - at[0]) and (equal > MIN_WORDS or n == len(y)) and (best is None or n > best[3] - best[2]):
                            best, part = (*at, equal), (p, q)
        if best is not None:
            out.append(best)
            todo += [(lo, part[0]), (part[1] + 1, hi)]
    return out


def covered(run: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> int:
    """The most words of b that one stretch of a covers.

    Tiles that follow each other in both texts with at most GAP words between form a chain, whose changed words count as covered.
    Blocks that lie together in a count as one stretch whatever their order in b (reordered passages), if each is a quote by itself:
    more than MIN_WORDS words, with the fewer edits the shorter it is.
    """
    x, y = a.tolist(), b.tolist()
    chains: list[list[tuple[int, int, int]]] = []
    for i, j, k in sorted(run):
        if chains and 0 <= i - sum(chains[-1][-1][::2]) <= GAP and 0 <= j - sum(chains[-1][-1][1:]) <= GAP:
            chains[-1].append((i, j, k))
        else:
            chains.append([(i, j, k)])
    best, seen, end = 0, set(), None
    for at, to, start, stop, equal in sorted(part for c in chains for part in stretches(c, x, y)):
        n = stop - start
        best = max(best, n)
        if n >= LONG or (n > MIN_WORDS and max(n, to - at) - equal <= n // DENSE):
            if end is None or at - end > 2 * GAP:
                seen = set()
            seen |= set(range(start, stop))
            best, end = max(best, len(seen)), to
    return best


class ItemIndex:
    """Runs of SEED words of a block of items, as sorted arrays."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        code, item, pos = [], [], []
        for i, t in zip(ids, texts):
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(t)], dtype=np.int64)
            if len(w) <= MIN_WORDS:
                continue
            self.ids.append(i)
            self.items.append(w)
            n = len(w) - SEED + 1
            code.append(self.codes(w))
            item.append(np.full(n, len(self.ids) - 1))
            pos.append(np.arange(n))
        code, self.item, self.pos = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (code, item, pos))
        order = np.argsort(code, kind="stable")
        self.item, self.pos = self.item[order], self.pos[order]
        self.keys, self.first = np.unique(code[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(code)))
        self.length = np.array([len(w) for w in self.items])

    @staticmethod
    def codes(w: np.ndarray) -> np.ndarray:
        c = w[: len(w) - SEED + 1].copy()
        for k in range(1, SEED):
            c = c * 2_000_003 + w[k : len(w) - SEED + 1 + k]
        return c

    def matches(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(position of the text, position of the item) of each leak."""
        get, docs = self.vocabulary.get, []
        for t in texts:
            docs.append(np.array([get(x, -1) for x in words(t)], dtype=np.int64))
        lengths = np.array([len(d) for d in docs])
        if not len(self.keys) or not lengths.sum():
            return []
        flat, start = np.concatenate(docs), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        if len(flat) < SEED:
            return []
        code, known = self.codes(flat), flat >= 0
        at = np.arange(len(code))
        whole = known[: len(code)].copy()
        for k in range(1, SEED):
            whole &= known[k : len(code) + k]
        doc = np.searchsorted(start, at, side="right") - 1
        while (empty := lengths[doc] == 0).any():
            doc[empty] -= 1
        whole &= at + SEED <= start[doc] + lengths[doc]
        at, doc, code = at[whole], doc[whole], code[whole]
        k = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        hit = self.keys[k] == code
        at, doc, k = at[hit], doc[hit], k[hit]
        n = self.count[k]
        if not n.sum():
            return []
        row = np.repeat(np.arange(len(k)), n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        item, ipos = self.item[post], self.pos[post]
        pair = doc[row] * len(self.ids) + item
        # seeds of a pair that lie together, as far apart as tiles of one stretch may be
        order = np.argsort(pair, kind="stable")
        pair, ipos, place = pair[order], ipos[order], at[row][order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (place[1:] - place[:-1] > APART)
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        pair, low, high = pair[new], place[new], place[np.append(begin[1:], len(place)) - 1]
        # the most words of the item that they may cover: their own, those of gaps, and those past the ends of chains
        seed = np.sort((group << 32) + ipos)
        seed = seed[np.append(True, seed[1:] != seed[:-1])]
        group, ipos = seed >> 32, seed & 0xFFFFFFFF
        new = np.ones(len(seed), bool)
        new[1:] = group[1:] != group[:-1]
        size = self.length[pair % len(self.ids)]
        own = np.minimum(np.diff(ipos, prepend=0), SEED)
        own[new] = SEED
        step = np.minimum(np.diff(ipos, prepend=0), WITHIN)
        step[new] = np.minimum(ipos[new], SEED)
        last = ipos[np.append(np.flatnonzero(new)[1:], len(seed)) - 1]
        most = np.add.reduceat(step, np.flatnonzero(new)) + SEED + np.minimum(size - SEED - last, SEED)
        # the words that a stretch of that many keeps, but for SEED - 1 past either end of a chain; two chains have 2 * LONG words at least
        least = np.maximum(MIN_WORDS + 1, COVERAGE * size)
        kept = np.where(least < 2 * LONG, LIGHT * least - 2 * (SEED - 1), (LIGHT - 2 * (SEED - 1) / LONG) * least)
        near = 2 * SEED + GAP  # words past the seeds of a stretch that it may have
        found = set()
        for g in np.flatnonzero((most >= least) & (np.add.reduceat(own, np.flatnonzero(new)) >= kept - 1e-6)).tolist():
            d, i = divmod(int(pair[g]), len(self.ids))
            if (d, i) in found:
                continue
            at = int(start[d])
            part, item = flat[max(at, int(low[g]) - near) : min(at + int(lengths[d]), int(high[g]) + SEED + near)], self.items[i]
            most_ = covered(tiles(part, item, SEED), part, item)
            if most_ > MIN_WORDS and most_ >= COVERAGE * len(item):
                found.add((d, i))
        return sorted(found)


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int = INDEX_LIMIT) -> list[DataFrame]:
    """The items in blocks of about `limit` bytes of text at most."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * 5 // (limit * 4))) if total > limit else 1
    return [rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) for b in range(n)]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) of each document that contains a passage of an item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    out = None
    for block in item_blocks(items, item_id, text_col):
        held = block.toArrow()
        index = spark.sparkContext.broadcast(ItemIndex(held.column(0).to_pylist(), held.column(1).to_pylist()))

        def find(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            x = index.value
            found = x.matches(b.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([d for d, _ in found], pa.int64())), pa.array([x.ids[i] for _, i in found], pa.int64())], ["doc_id", "item_id"])

        part = map_batches(rows, find, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
