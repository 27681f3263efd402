"""Sentence alignment in bilingual chunks.

First pass: sentences of a chunk are aligned by length alone (dynamic programming over one-to-one, one-to-two, two-to-one matches and
omissions). From its confident one-to-one matches, word-translation probabilities are trained by expectation-maximization over all
chunks; words that stand in both sentences explain each other and stay out. Second pass: dynamic programming over lexical scores, in
which every word counts by its rarity in the chunk; sentences that the monotone path leaves over are paired across it where the
words alone say so, which finds reordered sentences.

The sound pairs are written once, as numbers, to the shared folder; each round of EM is one pass over them with counts summed map-side,
so what moves is the table of word pairs and not the text. The table is pruned to translations of at least KEEP probability, which bounds
it by 1 / KEEP entries a source word. A table larger than BROADCAST_LIMIT goes out in blocks of target words, one pass each, since a
target word is explained by the entries of its own only; the entries that a chunk has are then joined to it. Counts are whole numbers,
so a lexicon is the same sent whole or in blocks. A chunk of any size is aligned whole: in tiles, whose scores follow from their own
sentences and the rarities of the whole chunk.

Defined results: chunks without a processed row or with a defect (module pairs) give no rows, nor do null or empty arrays; null and
blank elements hold no sentence; repeated rows count once; a sentence identical on both sides (also one without letters) pairs with
itself; one sentence may stand in several pairs or none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import blake2b
from itertools import chain, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import pairs
from foliant.llm.arrowtools import slices
from foliant.session import BROADCAST_LIMIT, shared_folder

#: Expected length of a translation a character of source, and the variance of that a character (in Gale and Church's sense).
GROWTH, SPREAD = 1.1, 3.0
#: Costs of matches other than one to one, in the length pass; a confident match costs less than CONFIDENT.
UNEVEN, SKIP, CONFIDENT = 2.5, 4.5, 1.2
#: Sentences that the length pass may stray from the diagonal at first; doubled while its best path touches the edge of the band.
BAND = 4
#: Rounds of expectation-maximization, and the least probability kept after a round.
ROUNDS, KEEP = 3, 0.02
#: One occurrence in the counts. They are whole numbers, so their sums, and what is pruned, do not depend on how rows and words are shared
#: out; a source word may stand in 2**33 pairs.
UNIT = 1 << 30
#: Word pairs that a worker counts before it hands them on.
HELD = 1_500_000
#: Sentences of a side, and their words, that are scored at once, and sentence pairs whose gains are held at once. What comes out does not
#: depend on them.
TILE, TILE_WORDS, STRIP = 100, 1500, 4_000_000
#: Chunks whose word pairs are counted at once.
EXPECT_ROWS = 250
#: Probability at which a translation explains its word fully.
SURE = 0.35
#: Score of a match that needs no search where it stands at an end.
CLEAR = 0.75
#: Explanations fainter than this are left out.
FAINT = 0.1
#: Lexical score a match must beat; what an uneven match must beat besides; the share of the other side that each part of an uneven
#: match must explain beyond the other part; and the scores of a crossing match and of a further part.
MATCH, UNEVEN_MATCH, PART, CROSS, FURTHER = 0.33, 0.06, 0.14, 0.5, 0.55

_SENTENCE = re.compile(r"[.!?…。]+[\"'”’»›)\]}」』]*(?=\s)")
#: Words and sentence hashes of both sides, and the words of the confident sentence pairs that the other side does not have itself.
_BITEXT = ("chapter_id string, chunk_id string, s_tokens array<int>, s_words array<int>, s_sign array<bigint>, t_tokens array<int>, t_words array<int>, t_sign array<bigint>, "
           "left array<int>, left_n array<int>, right array<int>, right_n array<int>")

_numbers: dict[str, int] = {}


def sentences(elements: list[str | None] | None) -> list[str]:
    """Sentences of an array of paragraphs, in order."""
    out = []
    for e in elements or ():
        if not e or not e.strip():
            continue
        at = 0
        for m in _SENTENCE.finditer(e):
            out.append(e[at : m.end()].strip())
            at = m.end()
        out.append(e[at:].strip())
    return [s for s in out if s]


def _number(word: str) -> int:
    """A stable 31-bit number of a word."""
    n = _numbers.get(word)
    if n is None:
        if len(_numbers) > 200_000:
            _numbers.clear()
        n = _numbers[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
    return n


def _bitext(chunks: DataFrame, processed: DataFrame, models) -> DataFrame:
    keys = ["chapter_id", "chunk_id"]
    a = chunks.groupBy(*keys).agg(F.max(F.struct("text", "paragraph_texts")).alias("s"))
    b = processed.groupBy(*keys).agg(F.max(F.struct("translation", "paragraph_translations")).alias("t"))
    rows = a.join(b, keys).select(*keys, "s.text", "s.paragraph_texts", "t.translation", "t.paragraph_translations")
    rows = rows.where(F.col("text").rlike(r"\p{L}") & ~F.col("text").rlike(pairs._URL) & (F.size("paragraph_texts") > 0) & (F.size("paragraph_translations") > 0))

    def side(texts: list[str]) -> tuple[list[list[int]], list[int]]:
        return [[_number(w) for w in pairs.words(s)] for s in texts], [int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for s in texts]

    def numbers(s: list[str], t: list[str]) -> tuple:
        (sw, s_sign), (tw, t_sign) = side(s), side(t)
        left, right = confident(sw, tw, [len(x) for x in s], [len(x) for x in t])
        flat = lambda x: [w for ws in x for w in ws]
        size = lambda x: [len(ws) for ws in x]
        return flat(sw), size(sw), s_sign, flat(tw), size(tw), t_sign, flat(left), size(left), flat(right), size(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _BITEXT.split(", ")]
        for whole in batches:
            for b in slices(whole):
                out = []
                cols = [b.column(i).to_pylist() for i in range(6)]
                # (chapter, chunk, text, source paragraphs, answer, answer's paragraphs)
                for chapter, chunk, text, source, answer, target, found in zip(*cols, pairs.languages_of(cols[4], models.value)):
                    if pairs.defect_of(text, answer, found):
                        continue
                    s, t = sentences(source), sentences(target)
                    if s and t:
                        out.append((chapter, chunk, *numbers(s, t)))
                cols = list(zip(*out)) if out else [[] for _ in names]
                kinds = [pa.string()] * 2 + [pa.list_(pa.int64() if n.endswith("_sign") else pa.int32()) for n in names[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return rows.mapInArrow(run, _BITEXT)


def _length_cost(a: float, b: float) -> float:
    mean = a * GROWTH
    return (b - mean) ** 2 / (2 * SPREAD * max(mean, 1.0))


def by_length(s: list[int], t: list[int]) -> list[tuple[int, int, float]]:
    """One-to-one matches (i, j, cost) of the cheapest alignment of sentence lengths."""
    if len(s) == len(t):  # leaving the diagonal and coming back costs two uneven matches or omissions at least
        straight = [(i, i, _length_cost(a, b)) for i, (a, b) in enumerate(zip(s, t))]
        if sum(c for *_, c in straight) <= 2 * min(UNEVEN, SKIP):
            return straight
    band = BAND
    while (found := _in_band(s, t, band)) is None:
        band *= 2
    return found


def _in_band(s: list[int], t: list[int], band: int) -> list[tuple[int, int, float]] | None:
    """The alignment within a band around the diagonal; None if the band is too narrow for it."""
    n, m, cost = len(s), len(t), _length_cost
    far = 1e18
    slope = m / max(n, 1)

    # rows keep the cells of the band only
    lows = [max(0, round(i * slope) - band) for i in range(n + 1)]
    highs = [min(m, round(i * slope) + band) for i in range(n + 1)]
    best = [[far] * (highs[i] - lows[i] + 1) for i in range(n + 1)]
    back = [[0] * (highs[i] - lows[i] + 1) for i in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row, low = best[i], lows[i]

        def reach(di: int, j: int, c: float, k: int) -> None:
            at = j - lows[i + di]
            if 0 <= at < len(best[i + di]) and c < best[i + di][at]:
                best[i + di][at], back[i + di][at] = c, k

        for j in range(low, highs[i] + 1):
            v = row[j - low]
            if v >= far:
                continue
            if i < n:
                if j < m:
                    reach(1, j + 1, v + cost(s[i], t[j]), 1)
                    if i + 1 < n:
                        reach(2, j + 1, v + UNEVEN + cost(s[i] + s[i + 1], t[j]), 4)
                    if j + 1 < m:
                        reach(1, j + 2, v + UNEVEN + cost(s[i], t[j] + t[j + 1]), 5)
                reach(1, j, v + SKIP, 2)
            if j < m:
                reach(0, j + 1, v + SKIP, 3)
    if best[n][m - lows[n]] >= far:
        return None
    out, i, j = [], n, m
    step = {1: (1, 1), 2: (1, 0), 3: (0, 1), 4: (2, 1), 5: (1, 2)}
    while i or j:
        if (j == lows[i] > 0) or (j == highs[i] < m):
            return None  # the best path may lie beyond
        k = back[i][j - lows[i]]
        di, dj = step[k]
        i, j = i - di, j - dj
        if k == 1:
            out.append((i, j, cost(s[i], t[j])))
    return out[::-1]


def confident(s: list[list[int]], t: list[list[int]], s_chars: list[int], t_chars: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Distinct words of confident sentence pairs that the other side does not have itself."""
    left, right = [], []
    for i, j, c in by_length(s_chars, t_chars):
        if c < CONFIDENT:
            x, y = set(s[i]), set(t[j])
            if x - y and y - x:
                left.append(list(x - y))
                right.append(list(y - x))
    return left, right


def _column(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of int lists."""
    c = b.column(b.schema.get_field_index(name))
    offsets = c.offsets.to_numpy()
    return c.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets.astype(np.int64) - offsets[0]


def _cross(s: np.ndarray, ns: np.ndarray, t: np.ndarray, nt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word pair keys of all sentence pairs, with the number of the target word's occurrence and the source words beside it."""
    size = ns * nt
    row = np.repeat(np.arange(len(ns)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    si = (np.cumsum(ns) - ns)[row] + inside // nt[row]
    ti = (np.cumsum(nt) - nt)[row] + inside % nt[row]
    return (s[si] << 31) | t[ti], ti, ns[row]


def _expect(bitext: DataFrame, table) -> DataFrame:
    """(pair, n): expected counts of word pairs, in UNITs, over all confident sentence pairs; `table` has (sorted pairs, probabilities) or None."""

    def batched(u: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(table.value[0]), np.int64) if table else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for whole in batches:
            for b in (whole.slice(at, EXPECT_ROWS) for at in range(0, whole.num_rows, EXPECT_ROWS)):
                words = [_column(b, x)[0] for x in ("left", "left_n", "right", "right_n")]
                if not len(words[1]):
                    continue
                key, occurrence, beside = _cross(*words)
                if table is None:
                    u, inverse = np.unique(key, return_inverse=True)
                    held.append((u, np.bincount(inverse, weights=np.rint(UNIT / beside)).astype(np.int64)))
                    if sum(len(k) for k, _ in held) > HELD:
                        yield from batched(*_merged(held))
                        held = []
                else:
                    keys, p = table.value
                    k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    v = np.where(keys[k] == key, p[k], 0.0)
                    norm = np.bincount(occurrence, weights=v)
                    share = v / np.maximum(norm[occurrence], 1e-12)
                    np.add.at(total, k, np.rint(share * UNIT).astype(np.int64))
        if table is None:
            u, n = _merged(held) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        else:
            u, n = table.value[0][total > 0], total[total > 0]
        yield from batched(u, n)

    return bitext.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
    u, inverse = np.unique(key, return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inverse, n)
    return u, total


def _lexicon(counts: DataFrame) -> DataFrame:
    """Maximisation: (pair, p), the probability of the target word given the source word, pruned to KEEP."""
    counts = counts.withColumn("s", F.shiftright("pair", 31))
    sums = counts.groupBy("s").agg(F.sum("n").alias("all"))
    return counts.join(sums, "s").select("pair", (F.col("n") / F.col("all")).alias("p")).where(F.col("p") >= KEEP)


def _blocks(lexicon: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (sorted pairs, probabilities) of a lexicon, in blocks of target words of about BROADCAST_LIMIT at most."""

    def arrays(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, p = got.column(0).to_numpy(), got.column(1).to_numpy()
        order = np.argsort(key)
        return np.ascontiguousarray(key[order]), np.ascontiguousarray(p[order])

    most = max(1, BROADCAST_LIMIT // 16)
    got = lexicon.limit(most + 1).toArrow()
    if got.num_rows <= most:
        yield arrays(got)
        return
    del got
    lexicon.write.parquet(to := shared_folder(lexicon.sparkSession, "lexicon"))
    held = lexicon.sparkSession.read.parquet(to)
    n = -(-held.count() * 5 // (most * 4))
    for b in range(n):
        got = held.where(F.pmod(F.xxhash64(F.col("pair").bitwiseAND(0x7FFFFFFF)), F.lit(n)) == b).toArrow()
        if got.num_rows:
            yield arrays(got)


def _each_block(blocks: Iterator[tuple[np.ndarray, np.ndarray]], first, bitext: DataFrame, fn: Callable, name: str) -> DataFrame:
    """fn(bitext, block) of all blocks, each a pass whose result is written, so one block is held at a time."""
    to = shared_folder(bitext.sparkSession, name)
    table = first
    while table is not None:
        fn(bitext, table).write.mode("append").parquet(to)
        table.unpersist()
        block = next(blocks, None)
        table = None if block is None else bitext.sparkSession.sparkContext.broadcast(block)
    return bitext.sparkSession.read.parquet(to)


def _entries(bitext: DataFrame, table) -> DataFrame:
    """(chapter_id, chunk_id, pair, p): the entries of a block of the lexicon that a chunk has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, p = table.value
        for whole in batches:
            for b in slices(whole):
                (s, so), (t, to) = _column(b, "s_tokens"), _column(b, "t_tokens")
                pair, value = [], []
                for k in range(b.num_rows):
                    key = ((np.unique(s[so[k] : so[k + 1]]) << 31)[:, None] | np.unique(t[to[k] : to[k + 1]])[None, :]).ravel()
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    at = at[keys[at] == key]
                    pair.append(keys[at])
                    value.append(p[at])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pair, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64()))], ["chapter_id", "chunk_id", "pair", "p"])

    return bitext.mapInArrow(run, "chapter_id string, chunk_id string, pair array<bigint>, p array<double>")


class Scores(NamedTuple):
    """How well some source sentences and some target ones translate each other."""

    one: np.ndarray  #: score of a pair: the mean of the two next
    fwd: np.ndarray  #: how far a target sentence is explained by a source one
    bwd: np.ndarray  #: how far a source sentence is explained by a target one
    forward: np.ndarray  #: how far each target word is explained by each source sentence
    backward: np.ndarray  #: how far each source word is explained by each target sentence
    in_s: np.ndarray  #: weights of source words in their sentences, of sum one
    in_t: np.ndarray
    s_all: np.ndarray  #: whole weights of the source sentences
    t_all: np.ndarray

    def gains(self, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What matches gain over leaving both out: of one sentence with one, of one with two targets, and of two with one target."""
        near, back, ahead = self.one[rows, cols], self.backward[:, cols], self.forward[rows]
        f, w, t_part, s_part = self.fwd[rows, cols], self.bwd[rows, cols], self.t_all[cols], self.s_all[rows]
        # two targets for a source: what either explains of the source; two sources for a target likewise
        both = self.in_s[rows] @ np.maximum(back[:, :-1], back[:, 1:])
        share = t_part[:-1] / np.maximum(t_part[:-1] + t_part[1:], 1e-9)
        split = (both + f[:, :-1] * share + f[:, 1:] * (1 - share)) / 2
        split[np.minimum(both - w[:, :-1], both - w[:, 1:]) < PART] = -1
        both = np.maximum(ahead[:-1], ahead[1:]) @ self.in_t[cols].T
        share = (s_part[:-1] / np.maximum(s_part[:-1] + s_part[1:], 1e-9))[:, None]
        merge = (both + w[:-1] * share + w[1:] * (1 - share)) / 2
        merge[np.minimum(both - f[:-1], both - f[1:]) < PART] = -1
        return near - MATCH, 2 * (split - MATCH) - UNEVEN_MATCH, 2 * (merge - MATCH) - UNEVEN_MATCH


class Side:
    """The sentences of one side of a chunk. A word weighs by its rarity: one over the sentences of the whole chunk that have it."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, sign: np.ndarray):
        self.tokens, self.counts, self.sign = tokens, counts, sign
        self.at = np.concatenate([[0], np.cumsum(counts)])

    @cached_property
    def having(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words, and the sentences that have each."""
        at = np.repeat(np.arange(len(self.counts)), self.counts)
        order = np.lexsort((at, self.tokens))
        word, at = self.tokens[order], at[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
        return np.unique(word[new], return_counts=True)

    def runs(self, most: int) -> list[tuple[int, int]]:
        """All sentences in runs of at most `most` sentences and TILE_WORDS words, or of one sentence."""
        if len(self.counts) <= most and len(self.tokens) <= TILE_WORDS:
            return [(0, len(self.counts))]
        out, a = [], 0
        while a < len(self.counts):
            b = int(np.searchsorted(self.at, self.at[a] + TILE_WORDS, side="right")) - 1
            out.append((a, a := min(max(b, a + 1), a + most, len(self.counts))))
        return out

    def weighed(self, which: list[int] | range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of some sentences, which sentence has which, their weights in a sentence (of sum one), and the sentences' whole weights."""
        tokens, counts, part = self.tokens, self.counts, which != range(len(self.counts))
        if part:
            tokens, counts = np.concatenate([tokens[self.at[i] : self.at[i + 1]] for i in which]), counts[list(which)]
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = np.empty(len(ranked), np.int64)
        at[order] = np.cumsum(new) - 1
        has = np.zeros((len(counts), int(new.sum())))
        has[np.repeat(np.arange(len(counts)), counts), at] = 1.0
        weight = has / np.maximum(self.having[1][np.searchsorted(self.having[0], ranked[new])] if part else has.sum(0), 1.0)
        whole = weight.sum(1)
        return ranked[new], has, weight / np.maximum(whole, 1e-9)[:, None], whole


class Aligner:
    """Aligns the sentences of chunks with a lexicon."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray]):
        key, p = lexicon[0], np.minimum(lexicon[1] / SURE, 1.0)
        key, p = key[p >= FAINT], p[p >= FAINT]
        order = np.argsort(key, kind="stable")
        source, self.target, self.p = (key >> 31)[order], (key & 0x7FFFFFFF)[order], p[order]
        # by source word, which has 1 / KEEP translations at most; a target word may stand for any number of source words
        self.source, self.first, self.count = np.unique(source, return_index=True, return_counts=True)

    def links(self, s_words: np.ndarray, t_words: np.ndarray) -> np.ndarray:
        """How far each target word is explained by each source word; fully by itself."""
        out = np.zeros((len(s_words), len(t_words)))
        if not out.size:
            return out
        if len(self.source):
            k = np.minimum(np.searchsorted(self.source, s_words), len(self.source) - 1)
            known = np.flatnonzero(self.source[k] == s_words)
            n = self.count[k[known]]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k[known]], n)
            c = np.minimum(np.searchsorted(t_words, self.target[entry]), len(t_words) - 1)
            fine = t_words[c] == self.target[entry]
            out[np.repeat(known, n)[fine], c[fine]] = self.p[entry][fine]
        r = np.minimum(np.searchsorted(s_words, t_words), len(s_words) - 1)
        same = np.flatnonzero(s_words[r] == t_words)
        out[r[same], same] = 1.0
        return out

    def _scores(self, s: Side, rows: list[int] | range, t: Side, cols: list[int] | range) -> Scores:
        s_words, s_has, in_s, s_all = s.weighed(rows)
        t_words, t_has, in_t, t_all = t.weighed(cols)
        link = self.links(s_words, t_words)
        forward, backward = np.minimum(s_has @ link, 1.0), np.minimum(link @ t_has.T, 1.0)
        fwd, bwd = forward @ in_t.T, in_s @ backward
        same = s.sign[rows][:, None] == t.sign[cols][None, :]
        fwd[same] = bwd[same] = 1.0
        return Scores((fwd + bwd) / 2, fwd, bwd, forward, backward, in_s, in_t, s_all, t_all)

    def align(self, s: np.ndarray, sc: np.ndarray, t: np.ndarray, tc: np.ndarray, s_sign: np.ndarray, t_sign: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of sentences; a side is its words, their numbers by sentence, and a hash of each sentence.

        Every sentence of a chunk is scored against every other, by the words of the two and their rarity in the whole chunk. Scores are
        computed in tiles, so memory is bounded; a chunk of one tile keeps them, a larger one computes them again where they are needed.
        """
        n, m = len(sc), len(tc)
        if not n or not m:
            return []
        left, right = Side(s, sc, s_sign), Side(t, tc, t_sign)
        rows, cols = left.runs(max(1, min(TILE, STRIP // m))), right.runs(TILE)
        held = self._scores(left, range(n), right, range(m)) if len(rows) == len(cols) == 1 else None

        def scores(which: list[int] | range, others: list[int] | range) -> Scores:
            return self._scores(left, which, right, others)

        # the best scores of each sentence, and those of the pairs counted from the start and from the end
        k = min(n, m)
        s_top, t_top, ahead, behind = np.zeros(n), np.zeros(m), np.zeros(k), np.zeros(k)
        fwd_top, fwd_at, bwd_top, bwd_at = np.full(m, -1.0), np.zeros(m, np.int64), np.full(n, -1.0), np.zeros(n, np.int64)
        for (a, b), (c, d) in product(rows, cols):
            x = held or scores(range(a, b), range(c, d))
            s_top[a:b], t_top[c:d] = np.maximum(s_top[a:b], x.one.max(1)), np.maximum(t_top[c:d], x.one.max(0))
            v = x.one.diagonal(a - c)
            ahead[max(a, c) :][: len(v)] = v
            v = x.one.diagonal(a - c + m - n)
            behind[max(a - (n - k), c - (m - k)) :][: len(v)] = v
            i, j = x.fwd.argmax(0), x.bwd.argmax(1)
            v, w = x.fwd[i, np.arange(d - c)], x.bwd[np.arange(b - a), j]
            new = v > fwd_top[c:d]  # of equal ones the first
            fwd_top[c:d][new], fwd_at[c:d][new] = v[new], i[new] + a
            new = w > bwd_top[a:b]
            bwd_top[a:b][new], bwd_at[a:b][new] = w[new], j[new] + c
        # clear matches at both ends need no search: each the best of its row and column
        ahead = ((ahead >= CLEAR) & (ahead >= s_top[:k]) & (ahead >= t_top[:k])).tolist()
        behind = ((behind >= CLEAR) & (behind >= s_top[n - k :]) & (behind >= t_top[m - k :])).tolist()[::-1]
        head = next((i for i in range(k) if not ahead[i]), k)
        tail = next((i for i in range(k) if not behind[i]), k)
        if n != m or head < k:  # the last before a gap may be one part of an uneven match
            head, tail = max(0, head - 1), max(0, tail - 1)
        tail = min(tail, k - head)
        out = {(i, i) for i in range(head)} | {(n - 1 - k, m - 1 - k) for k in range(tail)}
        if head + tail == n == m:
            return sorted(out)

        def gains(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Gains of the matches of sources a to b (of one with the source before) with all targets of the middle."""
            low, high, before = head, m - tail, max(a - 1, head)
            if held:
                return held.gains(slice(a, b), slice(low, high))
            near, split, merge = np.empty((b - a, high - low)), np.empty((b - a, max(high - low - 1, 0))), np.empty((b - before - 1, high - low))
            for c, d in _within(cols, low, high):
                first = max(c - 1, low)
                x, y, z = scores(range(before, b), range(first, d)).gains(slice(None), slice(None))
                near[:, c - low : d - low], split[:, first - low : d - 1 - low], merge[:, c - low : d - low] = x[a - before :, c - first :], y[a - before :], z[:, c - first :]
            return near, split, merge

        out |= {(i + head, j + head) for i, j in self._path(lambda a, b: gains(a + head, b + head), [(a - head, b - head) for a, b in _within(rows, head, n - tail)], m - tail - head)}
        # sentences left over, matched across the path, best first; then parts of sentences that are taken
        free_s, free_t = set(range(n)) - {i for i, _ in out}, set(range(m)) - {j for _, j in out}
        crossing = []
        for (a, b), (c, d) in product(rows, cols) if free_s and free_t else ():
            which, others = [i for i in range(a, b) if i in free_s], [j for j in range(c, d) if j in free_t]
            if which and others:
                one = held.one[np.ix_(which, others)] if held else scores(which, others).one
                i, j = np.nonzero(one >= CROSS)
                crossing += zip(one[i, j].tolist(), np.array(which)[i].tolist(), np.array(others)[j].tolist())
        for _, i, j in sorted(crossing, reverse=True):
            if i in free_s and j in free_t:
                out.add((i, j))
                free_s.discard(i)
                free_t.discard(j)
        for j in free_t:
            if fwd_top[j] >= FURTHER:
                i = int(fwd_at[j])
                taken = [y for x, y in out if x == i]
                if held:
                    weight, new, old = held.in_s[i], held.backward[:, j], held.backward[:, taken]
                else:
                    x = scores([i], [j, *taken])
                    weight, new, old = x.in_s[0], x.backward[:, 0], x.backward[:, 1:]
                if weight @ np.maximum(new - old.max(1, initial=0.0), 0) >= PART:
                    out.add((i, j))
        for i in free_s:
            if bwd_top[i] >= FURTHER:
                j = int(bwd_at[i])
                taken = [x for x, y in out if y == j]
                if held:
                    weight, new, old = held.in_t[j], held.forward[i], held.forward[taken]
                else:
                    x = scores([i, *taken], [j])
                    weight, new, old = x.in_t[0], x.forward[0], x.forward[1:]
                if weight @ np.maximum(new - old.max(0, initial=0.0), 0) >= PART:
                    out.add((i, j))
        return sorted(out)

    @staticmethod
    def _path(gains: Callable, strips: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
        """Matches on the best monotone path; gains(a, b) has what those of sources a to b gain over leaving both out.

        One strip of sources is held at a time; on the way back the ones before the last are computed again from the two rows before them.
        """

        def fill(a: int, b: int, before: np.ndarray, last: np.ndarray) -> tuple:
            one, split, merge = gains(a, b)
            best = np.empty((b - a + 2, m + 1))
            best[0], best[1] = before, last
            skipped = len(merge) - (b - a)  # -1 where no source stands before the strip
            for r in range(b - a):
                now = best[r + 2]
                now[:] = best[r + 1]
                np.maximum(now[1:], best[r + 1, :-1] + one[r], out=now[1:])
                np.maximum(now[2:], best[r + 1, :-2] + split[r], out=now[2:])
                if r + skipped >= 0:
                    np.maximum(now[1:], best[r, :-1] + merge[r + skipped], out=now[1:])
                np.maximum.accumulate(now, out=now)
            return a, best, one, split, merge, skipped

        starts, rows = [], (np.zeros(m + 1), np.zeros(m + 1))
        for a, b in strips:
            starts.append((a, b, *rows))
            held = fill(*starts[-1])
            rows = held[1][-2].copy(), held[1][-1].copy()
        out: list[tuple[int, int]] = []
        i, j = strips[-1][1] if strips else 0, m
        while i and j:
            while i <= starts[-1][0]:
                starts.pop()
            if held[0] != starts[-1][0]:
                held = fill(*starts[-1])
            a, best, one, split, merge, skipped = held
            r = i - 1 - a
            v = best[r + 2, j]
            if best[r + 1, j] == v:
                i -= 1
            elif best[r + 2, j - 1] == v:
                j -= 1
            elif best[r + 1, j - 1] + one[r, j - 1] == v:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif r + skipped >= 0 and best[r, j - 1] + merge[r + skipped, j - 1] == v:
                i, j = i - 2, j - 1
                out += (i, j), (i + 1, j)
            else:
                i, j = i - 1, j - 2
                out += (i, j), (i, j + 1)
        return out


def _within(runs: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The runs inside low to high."""
    return [(max(a, low), min(b, high)) for a, b in runs if max(a, low) < min(b, high)]


_held: list[tuple[object, Aligner]] = []


def aligned(chunks: DataFrame, processed: DataFrame, models) -> DataFrame:
    """(chapter_id, chunk_id, src_no, tgt_no): sentence pairs that translate each other."""
    spark = chunks.sparkSession
    to = shared_folder(spark, "bitext")
    _bitext(chunks, processed, models).write.parquet(to)
    bitext = spark.read.parquet(to)
    counts = _expect(bitext, None)
    for k in range(ROUNDS):
        blocks = _blocks(_lexicon(counts))
        lexicon = spark.sparkContext.broadcast(next(blocks))
        more = next(blocks, None)  # none where the lexicon is sent whole
        whole_lexicon = more is None
        if not whole_lexicon:
            blocks = chain([more], blocks)
        if k < ROUNDS - 1:
            counts = _expect(bitext, lexicon) if whole_lexicon else _each_block(blocks, lexicon, bitext, _expect, "counts")
    if not whole_lexicon:
        found = _each_block(blocks, lexicon, bitext, _entries, "entries").groupBy("chapter_id", "chunk_id").agg(F.collect_list(F.struct("pair", "p")).alias("x"))
        bitext = bitext.join(found.select("chapter_id", "chunk_id", F.flatten("x.pair").alias("pair"), F.flatten("x.p").alias("p")), ["chapter_id", "chunk_id"])
        lexicon = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        if whole_lexicon:
            if not _held or _held[0][0] is not lexicon.value:
                _held[:] = [(lexicon.value, Aligner(lexicon.value))]
            tool = _held[0][1]
        for whole in batches:
            for b in slices(whole):
                out = []
                cols = [_column(b, x) for x in ("s_tokens", "s_words", "t_tokens", "t_words", "s_sign", "t_sign")]
                for k, (chapter, chunk) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    own = tool or Aligner((b.column(b.schema.get_field_index("pair"))[k].values.to_numpy(), b.column(b.schema.get_field_index("p"))[k].values.to_numpy()))
                    out += [(chapter, chunk, i, j) for i, j in own.align(*(v[o[k] : o[k + 1]] for v, o in cols))]
                got = list(zip(*out)) if out else [[] for _ in range(4)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], ["chapter_id", "chunk_id", "src_no", "tgt_no"])

    return bitext.mapInArrow(run, "chapter_id string, chunk_id string, src_no int, tgt_no int")
