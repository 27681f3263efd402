"""Broken pairs of a source chunk and its translation, flagged with the kind of defect.

Prompt and answer are aligned as words. A copy is an answer whose shingles lie in the prompt and whose longest common subsequence
with it (bit-parallel) covers most of the answer, so typos, changed case, spacing and an introduction do not hide it. A refusal is
an answer of any length with a sentence to which a refusal template aligns, a template being a row of slots (what is not done, to
what) that stand in order with gaps between, where the source has no such sentence itself and its names and numbers are missing from
the answer (where it has none, the refusal makes up the most of the answer or the answer is short). A truncated answer is one whose anchors (names and numbers
that stand in both texts), aligned by longest common subsequence, show that what is missing lies after the last anchor and not
between two. The language of an answer without Indonesian words comes from the character models of langid.

One defect a pair, the first that holds of: empty, refusal, copy, other_language, truncated.

Defined results: chunks without letters, chunks that are one URL and chunks without a processed row are no cases; null and blank
answers, and answers without letters and digits, are empty; repeated rows of either side count once (of rows that differ under
one key, the greatest text counts, a text before a null); extra columns are ignored; recorded issues are handed on, not believed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtools import map_batches
from foliant.llm.folding import without_marks

SHINGLE, CONTAINED, COPIED = 3, 0.25, 0.6
#: Length of a whole translation against its source; share of it that must be missing at the end; and the fewest characters.
EXPANSION, MISSING, MISSING_CHARS = 1.1, 0.13, 40
#: An answer that ends with a whole sentence and is longer than this share of a whole translation has not stopped well before its end.
WELL_BEFORE = 0.71
#: Share of Indonesian function words that no text wholly in another language has.
INDONESIAN = 0.2
#: Words that may stand between two slots of a template; share of the source's names and numbers that an answer with a refusal beside a
#: translation has; and the length, against a whole translation, below which an answer to a source without any is short.
GAP, TRANSLATED, SHORT = 5, 0.4, 0.6

# Indonesian function words; and for the slots of refusal templates, ways to say that something is not done, what is done
# to texts, texts, and what happens to requests. Parts of phrases are joined by a blank.
FUNCTION_WORDS = frozenset("yang dan di itu ini dari ke pada untuk dengan tidak akan sebuah ada tersebut adalah dalam oleh saat bahwa karena aku kau saya mereka kita tetapi namun hanya sampai".split())
NOT_DONE = ("cannot", "can not", "can t", "could not", "couldn t", "won t", "will not", "am not", "m not", "are not", "unable", "not able", "decline", "declined", "refuse", "refused", "rather not", "not comfortable", "not allowed", "not permitted", "not possible", "must not", "may not", "not going to",
            "tidak", "tak", "belum", "bukan", "menolak", "enggan", "keberatan", "mustahil", "gagal")
TRANSLATING = ("translate", "translating", "translated", "translation", "render", "rendering", "menerjemahkan", "terjemahkan", "diterjemahkan", "terjemahan", "terjemahannya", "penerjemahan", "mengalihbahasakan", "dialihbahasakan")
DOING = ("help", "assist", "assisting", "process", "processed", "processing", "provide", "provided", "continue", "continued", "complete", "completed", "comply", "fulfil", "fulfill", "handle", "produce",
         "membantu", "dibantu", "memproses", "diproses", "memenuhi", "dipenuhi", "melanjutkan", "lanjutkan", "dilanjutkan", "mengerjakan", "dikerjakan", "menyelesaikan", "menyediakan", "memberikan", "melayani")
TEXTS = ("request", "requests", "text", "texts", "passage", "passages", "content", "material", "translation", "translating", "translate", "input", "excerpt", "prompt", "permintaan", "teks", "teksnya", "bagian", "konten", "terjemahan", "terjemahannya", "naskah", "materi", "isinya", "kutipan", "masukan")
MET = ("blocked", "denied", "rejected", "refused", "declined", "unavailable", "not available", "prohibited", "disallowed", "ditolak", "diblokir", "dilarang", "tidak tersedia", "tidak diizinkan")
SPEAKERS = ("as an ai", "as a language model", "as an assistant", "sebagai ai", "sebagai model bahasa", "sebagai asisten")
REFUSING = ("refuse", "decline", "cannot", "can t", "unable", "not able", "won t", "menolak", "tidak bisa", "tidak dapat", "tidak mampu", "tidak boleh", "tak bisa", "tak dapat", "belum bisa", "belum dapat", "keberatan")
UNWILLING = ("rather not", "prefer not", "wish not", "decline", "refuse", "not comfortable", "not willing", "unwilling", "cannot", "can t", "won t", "will not", "unable", "not able")
GOING_ON = ("continue", "continuing", "proceed", "proceeding", "go on", "engage", "engaging", "write", "writing", "work", "working")
NO_TRANSLATION = ("no", "tidak ada", "tanpa", "without")
AVAILABLE = ("available", "provided", "possible", "tersedia")
#: Templates, each a row of slots.
REFUSALS = ((NOT_DONE, TRANSLATING), (NOT_DONE, DOING, TEXTS), (TEXTS, NOT_DONE, DOING), (TEXTS, MET), (MET, TEXTS), (TRANSLATING, NOT_DONE, DOING), (SPEAKERS, REFUSING), (UNWILLING, GOING_ON), (NO_TRANSLATION, TRANSLATING, AVAILABLE))

FLAGS = "chapter_id string, chunk_id string, defect string, evidence double, recorded array<string>"

_WORD = re.compile(r"[^\W_]+")
_ANCHOR = re.compile(r"\d+|[A-ZÀ-Þ][\w­​-‍]{2,}")
#: Capitalised words that only open sentences.
_OPENERS = frozenset("The And But Then When After Before With From That This There They His Her She Who What Why How For Not One All".split())
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”’»)\]]*\s+|\n+")
_STOPPED = re.compile(r"[.!?。！？][\"'”’»)\]}」』]*\s*$")
_OPEN_END = re.compile(r"(?:\.\.\.|…|\[[\s.…]*\])[\"'”’»)\]]*\s*$")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_URL = r"(?i)^\s*(https?://|www\.)\S+\s*$"


def fold(text: str) -> str:
    return without_marks(text.lower())


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel in the length of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _reached(a: list[str], b: list[str]) -> tuple[int, int]:
    """(least n for which the first n words of a have the longest common subsequence with b that all of a has, its length)."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v, at, length = full, 0, 0
    for i, w in enumerate(a):
        u = v & places.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
            if (n := len(b) - v.bit_count()) > length:
                at, length = i + 1, n
    return at, length


def _slot(phrases: tuple[str, ...]) -> dict[str, list[tuple[str, ...]]]:
    out: dict[str, list[tuple[str, ...]]] = {}
    for p in phrases:
        first, *rest = p.split()
        out.setdefault(first, []).append(tuple(rest))
    return out


_TEMPLATES = tuple(tuple(map(_slot, t)) for t in REFUSALS)


def _aligned(template: tuple, ws: list[str]) -> bool:
    """Whether a template's slots stand in order in the words, at most GAP words between two."""
    ends: set[int] = set()
    for k, slot in enumerate(template):
        now = set()
        for i, w in enumerate(ws):
            if w in slot and (not k or any(i - d in ends for d in range(GAP + 1))):
                now |= {i + 1 + len(rest) for rest in slot[w] if tuple(ws[i + 1 : i + 1 + len(rest)]) == rest}
        if not now:
            return False
        ends = now
    return True


def _possible(have: set[str]) -> list[tuple]:
    """The templates each of whose slots begins with one of the words."""
    return [t for t in _TEMPLATES if not any(slot.keys().isdisjoint(have) for slot in t)]


def refusing(text: str) -> tuple[int, int]:
    """(words of the sentences that a refusal template aligns to, words of all)."""
    refused = total = 0
    for sentence in _SENTENCE.split(text):
        ws = words(sentence)
        total += len(ws)
        if any(_aligned(t, ws) for t in _possible(set(ws))):
            refused += len(ws)
    return refused, total


def refusal_score(source: str, answer: str, got: list[str]) -> float:
    """Share of an answer's words that refuse instead of translating; 0 if it is no refusal."""
    if not _possible(set(got)):
        return 0.0
    refused, total = refusing(answer)
    if not refused or refusing(source)[0]:
        return 0.0
    anchors = {m.group() for m in _ANCHOR.finditer(source)} - _OPENERS
    if anchors:
        fine = len(anchors & {m.group() for m in _ANCHOR.finditer(answer)}) < TRANSLATED * len(anchors)
    else:
        fine = refused * 2 >= total or len(answer) < SHORT * EXPANSION * len(source)
    return refused / total if fine else 0.0


def copy_score(source: list[str], answer: list[str]) -> float:
    """Share of the answer's words that are the source's in order; 0 where few shingles are shared."""
    if len(answer) < SHINGLE:
        return common(source, answer) / len(answer) if answer else 0.0
    known = set(source)
    if sum(w in known for w in answer) < CONTAINED * (len(answer) - SHINGLE + 1):
        return 0.0  # as few shingles can be shared
    held = set(zip(source, source[1:], source[2:]))
    shingles = list(zip(answer, answer[1:], answer[2:]))
    if sum(s in held for s in shingles) < CONTAINED * len(shingles):
        return 0.0
    return common(source, answer) / len(answer)


def missing_end(source: str, answer: str) -> float:
    """Characters of a whole translation that are missing after the last anchor both texts have in the same order."""
    a = [(m.group(), m.end()) for m in _ANCHOR.finditer(source)]
    b = [(m.group(), m.end()) for m in _ANCHOR.finditer(answer)]
    keep = {w for w, _ in a} & {w for w, _ in b}
    a, b = [x for x in a if x[0] in keep], [x for x in b if x[0] in keep]
    end_a = end_b = 0
    # of the best alignments the one that ends earliest, in the source and then in the answer
    i, whole = _reached([w for w, _ in a], [w for w, _ in b])
    if whole:
        j, _ = _reached([w for w, _ in b], [w for w, _ in a[:i]])
        end_a, end_b = a[i - 1][1], b[j - 1][1]
    rest = answer[end_b:]
    # a sentence in a script without spaces is as long as one of about three times its characters
    rest_length = len(rest) + 2 * len(_DENSE.findall(rest))
    return EXPANSION * (len(source) - end_a) - rest_length


def maybe_foreign(answer: str | None) -> bool:
    """Whether an answer may be wholly in a language other than Indonesian, so that its languages must be known."""
    got = _WORD.findall(answer.lower()) if answer else []
    return bool(got) and sum(w in FUNCTION_WORDS for w in got) < INDONESIAN * len(got)


def defect_of(source: str, answer: str | None, languages: dict[str, int]) -> tuple[str, float] | None:
    """(defect, evidence) of a pair, None if it is sound. `languages` has the characters of each language in an answer that may be foreign."""
    if answer is None or not any(c.isalnum() for c in answer):
        return "empty", 1.0
    got = words(answer)
    if s := refusal_score(source, answer, got):
        return "refusal", s
    if (s := copy_score(words(source), got)) >= COPIED:
        return "copy", s
    total = sum(languages.values())
    if total and (share := 1 - (languages.get("id", 0) + languages.get("en", 0)) / total) >= 0.9:
        return "other_language", share
    size = EXPANSION * len(source)
    short = len(answer) < WELL_BEFORE * size
    cut = len(answer) < 0.9 * size and _STOPPED.search(source) and (not _STOPPED.search(answer) or (_OPEN_END.search(answer) and not _OPEN_END.search(source)))
    if short or cut:
        gap = missing_end(source, answer)
        if (short and gap >= MISSING * size and gap >= MISSING_CHARS) or (cut and gap >= MISSING / 2 * size):
            return "truncated", gap / size
    return None


def languages_of(answers: list[str | None], model) -> list[dict[str, int]]:
    """The characters of each language in the answers that may be foreign; nothing for the others."""
    at = [i for i, a in enumerate(answers) if maybe_foreign(a)]
    out: list[dict[str, int]] = [{} for _ in answers]
    for i, found in zip(at, model.segments([answers[i] for i in at]) if at else ()):
        for _, _, lang, n, _ in found:
            out[i][lang] = out[i].get(lang, 0) + n
    return out


def joined_pairs(chunks: DataFrame, processed: DataFrame, source: str = "text", answer: str = "translation") -> DataFrame:
    """(chapter_id, chunk_id, source, answer, recorded): each chunk that has a processed row, once.

    Both sides are folded by key before they meet, map-side first, so copies of a row never multiply or gather in one task.
    """
    keys = ["chapter_id", "chunk_id"]
    a = chunks.groupBy(*keys).agg(F.max(source).alias("source"))
    b = processed.groupBy(*keys).agg(F.max(answer).alias("answer"), F.max(F.transform("issues", lambda i: i["rule"])).alias("recorded"))
    return a.join(b, keys)


def defects(chunks: DataFrame, processed: DataFrame, models) -> DataFrame:
    """Defective pairs: chapter_id, chunk_id, defect, evidence (from 0 to 1), recorded (rules of the issues on record)."""
    rows = joined_pairs(chunks, processed).where(F.col("source").rlike(r"\p{L}") & ~F.col("source").rlike(_URL))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        cols = [b.column(i).to_pylist() for i in range(5)]
        for chapter, chunk, source, answer, recorded, found in zip(*cols, languages_of(cols[3], models.value)):
            got = defect_of(source, answer, found)
            if got:
                out.append((chapter, chunk, *got, recorded))
        cols: Iterable = list(zip(*out)) if out else [[] for _ in range(5)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in FLAGS.split(", ")])

    return map_batches(rows, run, FLAGS)
