"""Language of texts and of their segments, by interpolated Kneser-Ney character models in sorted hash arrays.

One model of character n-grams up to ORDER for each language is fitted on a bounded sample of labelled documents (about
SAMPLE_DOCS and at most SAMPLE_BYTES a language, of documents of at most LONGEST bytes, chosen by a hash of their ids; the bound holds
at every corpus size and is the only one: every item is scored whole). All languages share one sorted array
of n-gram hashes an order, with a row of log-probabilities beside each key, so one binary search scores a character under every
language. A text is cut at sentence ends and line breaks; each sentence takes the language of the lowest length-normalised
cross-entropy, unless that lies outside what held-out sentences of the language reach (rejection) or the sentence is shorter than
MIN_WORDS words (MIN_CHARS characters where no spaces are written). Texts are scored whole, in one pass, without a shuffle.

Defined results: null, empty and letterless texts, and texts of short sentences only, have no language and give no segment; a
label is compared by its first subtag in lower case, and null, empty and blank labels count as missing; repeated rows of an item
count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtools import map_batches

ORDER, MIN_WORDS, MIN_CHARS = 4, 4, 9
#: Bounds of the sample that the models are fitted on, a language: documents, bytes, and bytes of one document.
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 500, 4_000_000, 400_000
#: One in so many sampled texts is held out for calibration; a sentence is rejected above so many times the held-out mean plus a margin
#: in nats, which leaves room for other subjects than the sample's.
HELD_OUT, REJECT, MARGIN = 5, 1.5, 3.4
#: Confidence below which a sentence has no language.
SURE = 0.95
#: Characters scored at once.
SLICE = 400_000

LANGUAGES = "item_kind string, item_id string, label string, lang string, chars bigint, confidence double"
SEGMENTS = "item_kind string, item_id string, segment_no int, start int, stop int, lang string, confidence double"

_URL = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point of the first plane: the model's symbol, whether it belongs to a word, and its script.

    Scripts: 1 Latin, 2 one without spaces, 3 Cyrillic, 4 any other, 0 none (digits and what is in no word).
    """
    plain, word, script = np.full(65536, 32, np.uint32), np.zeros(65536, bool), np.zeros(65536, np.uint8)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            plain[c] = 48 if ch.isdigit() else ord(low) if len(low) == 1 else c
            word[c] = True
            if not ch.isdigit():
                script[c] = 1 if c < 0x250 or 0x1E00 <= c < 0x1F00 else 2 if 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 else 3 if 0x400 <= c < 0x530 else 4
    return plain, word, script


_PLAIN, _WORDY, _SCRIPT = _tables()


def _beyond() -> np.ndarray:
    """Stand-ins in the first plane for the second: what a mathematical or enclosed letter is a form of, else a blank."""
    out = np.full(65536, 32, np.uint32)
    for c in range(0x1D400, 0x1F200):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and ord(plain) < 65536:
            out[c - 65536] = ord(plain)
    return out


_BEYOND = _beyond()


def _codes(text: str) -> np.ndarray:
    """Code points of the first plane: ideographs of later planes stand as the first of extension A, other characters as their plain form."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(c) or c.max() < 65536:
        return c
    return np.where(c < 65536, c, np.where(c < 131072, _BEYOND[c & 0xFFFF], 0x3400)).astype(np.uint32)


def _hash(c: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k-grams that start at the given positions, by default all."""
    h = np.zeros(len(c) - k + 1 if at is None else len(at), np.uint64)
    for j in range(k):
        h += (c[j : len(c) - k + 1 + j] if at is None else c[at + j]).astype(np.uint64)
        h += np.uint64(1)
        h *= _MULT
        h ^= h >> np.uint64(29)
    return h


def _enders() -> np.ndarray:
    """By code point: 1 ends a sentence before white space, 2 ends one anywhere, 3 may close one, 4 is white space, 5 a line break."""
    out = np.zeros(65536, np.uint8)
    for kind, chars in ((1, ".!?…"), (2, "。！？"), (3, "\"'”’»)]}」』"), (4, " \t\r\u00a0\u3000"), (5, "\n")):
        for ch in chars:
            out[ord(ch)] = kind
    return out


_ENDER = _enders()


def boundaries(joined: np.ndarray) -> np.ndarray:
    """Positions after which a sentence or line ends, in the code points of texts that end with line breaks."""
    kind = _ENDER[joined]
    soft, hard = kind == 1, kind == 2
    for _ in range(3):  # closing quotes and brackets belong to the sentence before them
        close = kind[1:] == 3
        soft[1:] |= close & soft[:-1]
        hard[1:] |= close & hard[:-1]
    blank = np.append(kind[1:] >= 4, True)
    open_ = np.append(kind[1:] != 3, True)
    more = np.append(kind[1:] == 2, False)
    return np.flatnonzero((soft & blank) | (hard & open_ & ~more) | (kind == 5)) + 1


class LanguageModels:
    """The models of all languages. `samples` has the texts of each language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.script = np.array([np.bincount(_SCRIPT[_codes("".join(samples[l]))], minlength=5)[1:].argmax() + 1 for l in self.langs])
        fit = {l: [t for i, t in enumerate(samples[l]) if i % HELD_OUT] or samples[l] for l in self.langs}
        self._fit([_PLAIN[_codes("   " + "   ".join(fit[l]) + " ")] for l in self.langs])
        self.limit = np.full(len(self.langs), np.inf)
        for j, l in enumerate(self.langs):
            held = [t for i, t in enumerate(samples[l]) if i % HELD_OUT == 0] or samples[l]
            ce = [e[j] for t in held for e, n in zip(*self.entropies(t)) if n and np.isfinite(e[j])]
            self.limit[j] = REJECT * np.mean(ce) + MARGIN if ce else 5.0

    def _fit(self, texts: list[np.ndarray]) -> None:
        n_langs = len(texts)
        self.keys, self.logp, self.log_gamma = {}, {}, {}
        counts, prefix, suffix = {}, {}, {}
        for k in range(1, ORDER + 1):
            hashes = [_hash(t, k) for t in texts]
            keys = np.unique(np.concatenate(hashes))
            c = np.zeros((len(keys), n_langs))
            pre, suf = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for j, (t, h) in enumerate(zip(texts, hashes)):
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                rows = np.searchsorted(keys, u)
                c[rows, j] = n
                if k > 1:
                    low = _hash(t, k - 1)
                    pre[rows] = np.searchsorted(self.keys[k - 1], low[at])
                    suf[rows] = np.searchsorted(self.keys[k - 1], low[at + 1])
            self.keys[k], counts[k], prefix[k], suffix[k] = keys, c, pre, suf
        for k in range(1, ORDER):  # all but the highest order count in how many contexts an n-gram stands
            cont = np.zeros_like(counts[k])
            np.add.at(cont, suffix[k + 1], counts[k + 1] > 0)
            counts[k] = cont
        below = None
        for k in range(1, ORDER + 1):
            c = counts[k]
            one, two = (c == 1).sum(0), (c == 2).sum(0)
            d = np.clip(one / np.maximum(one + 2 * two, 1), 0.3, 0.95)
            if k == 1:
                total, types = np.maximum(c.sum(0), 1), (c > 0).sum(0)
                gamma = d * types / total
                p = np.maximum(c - d, 0) / total + gamma / 20_000
                self.unseen = np.log(np.maximum(gamma, 1e-4) / 20_000).astype(np.float32)
            else:
                total, types = np.zeros_like(counts[k - 1]), np.zeros_like(counts[k - 1])
                np.add.at(total, prefix[k], c)
                np.add.at(types, prefix[k], c > 0)
                gamma = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
                p = np.where(total[prefix[k]] > 0, np.maximum(c - d, 0) / np.maximum(total[prefix[k]], 1), 0) + gamma[prefix[k]] * below[suffix[k]]
                self.log_gamma[k] = np.log(np.clip(gamma, 1e-6, 1)).astype(np.float32)
            below = p
            self.logp[k] = np.log(np.maximum(p, 1e-12)).astype(np.float32)

    def _find(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys[k], h), len(self.keys[k]) - 1)
        return at, self.keys[k][at] == h

    def char_scores(self, c: np.ndarray) -> np.ndarray:
        """log P of each symbol of c under each language; c starts with ORDER - 1 symbols of padding that are not scored."""
        n = len(c) - ORDER + 1
        todo = np.arange(n)
        for k in range(ORDER, 0, -1):
            at, hit = self._find(k, _hash(c, k) if k == ORDER else _hash(c, k, todo + ORDER - k))
            if k == ORDER:
                out = self.logp[k][at]
                out[~hit] = 0
            else:
                out[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k > 1:
                ctx, seen = self._find(k - 1, _hash(c, k - 1, todo + ORDER - k))
                out[todo[seen]] += self.log_gamma[k][ctx[seen]]
            else:
                out[todo] += self.unseen
        return out

    def entropies(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each sentence under each language, and the characters it counts with (0: too short)."""
        e, n, _, _ = self.batch([text])
        return e, n

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As entropies, for the sentences of all texts in order; with each sentence's end and each text's start in the joined texts."""
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        joined = _codes(_URL.sub(lambda m: " " * len(m.group()), "\n".join(texts) + "\n"))
        stops = boundaries(joined)
        starts = np.append(0, stops[:-1])
        c, wordy, script = _PLAIN[joined], _WORDY[joined], _SCRIPT[joined]
        c = np.concatenate([np.full(ORDER - 1, 32, np.uint32), c])
        first = wordy & ~np.concatenate([[False], wordy[:-1]])
        counted = lambda flags: (s := np.concatenate([[0], np.cumsum(flags)]))[stops] - s[starts]
        words, chars = counted(first), counted(wordy)
        letters = np.stack([counted(script == k) for k in range(1, 5)], 1)
        main = letters.argmax(1) + 1 if len(letters) else np.empty(0, np.int64)
        # letters of a script without spaces weigh double: names in Latin letters stand among few of them
        main = np.where(letters[:, 1] * 2 > letters[:, 0], np.where(main == 1, 2, main), main)
        enough = (letters.sum(1) > 0) & np.where(main == 2, letters[:, 1] >= MIN_CHARS, words >= MIN_WORDS)
        live = np.flatnonzero(enough)
        sums = np.zeros((len(stops), len(self.langs)))
        used = np.zeros(len(stops), np.int64)
        i = 0
        while i < len(live):
            j = i + 1
            while j < len(live) and stops[live[j]] - starts[live[i]] <= SLICE:
                j += 1
            a, b = starts[live[i]], stops[live[j - 1]]
            score = self.char_scores(c[a : b + ORDER - 1])
            score *= wordy[a:b, None]
            # a row of zeros at the end lets the last sentence stop there
            score = np.concatenate([score, np.zeros((1, score.shape[1]), np.float32)])
            sums[live[i:j]] = np.add.reduceat(score, np.stack([starts[live[i:j]] - a, stops[live[i:j]] - a], 1).ravel(), axis=0)[::2]
            used[live[i:j]] = chars[live[i:j]]
            i = j
        entropy = -sums / np.maximum(used, 1)[:, None]
        entropy[self.script[None, :] != main[:, None]] = np.inf
        return entropy, used, stops, offsets

    def decide(self, entropy: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (by number, -1: none) of each sentence and its confidence."""
        best = entropy.argmin(1) if len(entropy) else np.empty(0, np.int64)
        low = entropy[np.arange(len(best)), best]
        known = np.isfinite(low)
        with np.errstate(invalid="ignore"):
            gap = np.exp(np.clip(-(entropy - np.where(known, low, 0)[:, None]) * used[:, None] * 0.25, -60, 0))
        sure = 1 / np.maximum(gap.sum(1), 1e-9) if len(entropy) else np.empty(0)
        fine = (used > 0) & (low <= self.limit[best]) & (sure >= SURE)
        return np.where(fine, best, -1), sure

    def segments(self, texts: list[str]) -> list[list[tuple[int, int, str, int, float]]]:
        """For each text its segments: (start, stop, language, characters, confidence), neighbouring sentences of a language in one."""
        entropy, used, stops, offsets = self.batch(texts)
        label, sure = self.decide(entropy, used)
        live = np.flatnonzero(label >= 0)
        owner = np.searchsorted(offsets, stops[live], side="left") - 1
        out: list[list[tuple[int, int, str, int, float]]] = [[] for _ in texts]
        begin = np.append(0, stops)[live]
        for t, start, stop, k, n, p in zip(owner.tolist(), begin.tolist(), stops[live].tolist(), label[live].tolist(), used[live].tolist(), sure[live].tolist()):
            found, lang, at = out[t], self.langs[k], int(offsets[t])
            stop = min(stop - at, len(texts[t]))
            if found and found[-1][2] == lang:
                s, _, _, m, q = found[-1]
                found[-1] = (s, stop, lang, m + n, (q * m + p * n) / (m + n))
            else:
                found.append((start - at, stop, lang, n, p))
        return out


def sample_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """About n whole documents and at most about `most` bytes of each language with a label, chosen by a hash of their ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang_of_label(F.col(lang_col)).alias("lang"))
    rows = rows.where((F.octet_length("text") > 0) & (F.octet_length("text") <= LONGEST) & F.col("lang").isNotNull())
    have = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row a language code
    part = F.lit(0)
    for r in have:
        part = F.when(F.col("lang") == r["lang"], int(min(1.0, n / r["n"], most / r["bytes"]) * 1_000_000)).otherwise(part)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part).select("lang", "text").toPandas()
    return {lang: sorted(g["text"]) for lang, g in chosen.groupby("lang")}


def lang_of_label(label: Column) -> Column:
    """Two-letter language of a label, null if there is none."""
    first = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(first == "", None).otherwise(first)


def fit(docs: DataFrame):
    """The models, broadcast: their size is bounded by the sample's."""
    return docs.sparkSession.sparkContext.broadcast(LanguageModels(sample_documents(docs)))


def text_languages(items: DataFrame, models) -> DataFrame:
    """One row for each language in each item (item_kind, item_id, label, text): its characters and confidence."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, out = models.value, []
        ids = list(zip(*(b.column(i).to_pylist() for i in range(3))))
        for key, found in zip(ids, m.segments(b.column(3).to_pylist())):
            per: dict[str, list[float]] = {}
            for _, _, lang, n, p in found:
                x = per.setdefault(lang, [0, 0.0])
                x[0] += n
                x[1] += p * n
            out += [(*key, lang, n, p / n) for lang, (n, p) in per.items()]
        cols = list(zip(*out)) if out else [[] for _ in range(6)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in LANGUAGES.split(", ")])

    rows = items.select("item_kind", "item_id", "label", "text").where(F.col("text").rlike(r"\p{L}"))
    return map_batches(rows, run, LANGUAGES)


def text_segments(items: DataFrame, models) -> DataFrame:
    """Each item's segments of one language, in order, with their confidence."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        ids = list(zip(*(b.column(i).to_pylist() for i in range(2))))
        for key, found in zip(ids, models.value.segments(b.column(2).to_pylist())):
            out += [(*key, i, s, e, lang, p) for i, (s, e, lang, _, p) in enumerate(found)]
        cols = list(zip(*out)) if out else [[] for _ in range(7)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])

    rows = items.select("item_kind", "item_id", "text").where(F.col("text").rlike(r"\p{L}")).distinct()
    return map_batches(rows, run, SEGMENTS)


def mislabelled(languages: DataFrame) -> DataFrame:
    """(item_kind, item_id, lang): one row for each language of the items whose label is missing, is not the main language, or that mix."""
    per = languages.distinct().groupBy("item_kind", "item_id").agg(
        F.max("label").alias("label"), F.collect_set("lang").alias("langs"), F.max(F.struct("chars", "lang"))["lang"].alias("main"))
    bad = lang_of_label(F.col("label")).isNull() | (lang_of_label(F.col("label")) != F.col("main")) | (F.size("langs") > 1)
    return per.where(bad).select("item_kind", "item_id", F.explode("langs").alias("lang"))


def translation_items(processed: DataFrame, assembled: DataFrame) -> DataFrame:
    """(item_kind, item_id, label, text) of chunk translations and assembled paragraphs."""
    a = processed.select(F.lit("chunk").alias("item_kind"), F.concat("chapter_id", F.lit("/"), "chunk_id").alias("item_id"), F.col("lang").alias("label"), F.col("translation").alias("text"))
    b = assembled.select(F.lit("paragraph").alias("item_kind"), F.col("paragraph_id").alias("item_id"), F.col("lang").alias("label"), F.col("translated_text").alias("text"))
    return a.unionByName(b)
