"""Texts decoded with a wrong encoding, found and restored with a hidden Markov model.

The model has a clean state, one state for each pair (the encoding a text was written in, the encoding it was read with), and a
lost state for characters that no encoding gives back. It labels the characters outside ASCII, run by run: within a run the
cheapest path chooses, character by character, between the clean state and a damaged one whose bytes decode there, so damage is
found beside right quotes, dashes and letters too. A state's emission is the likelihood of what its inverse transform makes of its
characters, in their context, under one model of clean text: character bigrams counted over all documents. The clean state's is
that of the characters as they stand. Entering a damaged state costs ENTER, so a rare but right character stays clean; the cheapest
path through a document's runs labels them, and every labelled span gets the inverse transform of its state.

Characters of Latin, Greek, Cyrillic and symbol blocks are symbols of their own, all others count by block with their own
frequency in it, so the model has at most the square of some 2,800 symbols and in practice a few thousand pairs: its size does not
follow the documents.

Scripts that the documents hardly have get a bigram probability of their own, less the more the documents have of them, so that a
restored text of a new script can win against its garbled form.

Defined results: null, empty and ASCII-only texts are clean; repeated rows are labelled alike; a damaged span whose inverse
transform fails anywhere, or for which a state with another result is about as likely (within SURE), is reported and left as it
stands (`restored` false); other columns are dropped.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrowtools import map_batches

#: Cost (in nats) of entering a damaged state, what it is less for UTF-8 (whose valid sequences are no accident) and more for an
#: uncommon pair, and the cost of leaving.
ENTER, SPECIFIC, UNCOMMON, LEAVE = 6.0, 2.5, 5.0, 1.0
#: Cost of a lost character, of one replaced in the wrong reading whose byte is guessed, and of a byte that does not decode.
LOST, GUESSED, BROKEN = 4.0, 3.0, 14.0
#: Probability that a Latin letter or punctuation mark has at least, seen in the documents or not.
RARE = 4e-6
#: Cost of changing from one damaged state to another besides entering it, and of a letter in place of a sign that stands alone.
CHANGE, ALONE = 9.0, 5.0

#: Nats by which a span's state must beat all that give another text for the span to be restored.
SURE = 2.0
#: Characters of documents in a script at which its own probability of a letter after another counts half; that probability; and how
#: much less likely a word's first letter is (in nats).
NEW_SCRIPT, WITHIN_SCRIPT, FIRST = 200, 1 / 80, 8.0
#: Right punctuation outside ASCII that may stand beside damage.
PUNCTUATION = "\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2026\u00ab\u00bb\u00a1\u00bf\u3000-\u3003\u3008-\u3011\uff01\uff0c\uff1f"

READ_WITH = ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-2", "iso8859-15")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp1256", "cp874", "iso8859-2", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp932", "euc_jp", "gbk", "big5", "euc_kr")
#: Scripts by their code points, for those that the documents hardly have.
SCRIPTS = ((0x370, 0x400), (0x400, 0x530), (0x5D0, 0x5F0), (0x600, 0x700), (0xE00, 0xE80), (0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0))
#: States: (written in, read with, times).
STATES = tuple((s, r, 1) for r in READ_WITH for s in WRITTEN_IN if s != r and (s, r) != ("cp1252", "latin-1")) + (("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2))



def enter_cost(state: tuple[str, str, int] | None) -> float:
    """Cost of entering a state (None: the lost state). Uncommon are old code pages that were not read as their successors."""
    if state is None:
        return ENTER
    written, read, _ = state
    if written == "utf-8":
        return ENTER - SPECIFIC
    western = ("latin-1", "cp1252", "iso8859-15")
    return ENTER if read in western or (written == "cp1252" and read != "iso8859-2") else ENTER + UNCOMMON


SPANS = "doc_id bigint, start int, stop int, written_in string, read_with string, damaged string, restored_text string, restored boolean"

_RUN = re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f]|[!-~](?=[^\x00-\x7f]))*")
_OWN = ((0x0, 0x250), (0x370, 0x530), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2190, 0x2600), (0xFB00, 0xFB07), (0xFFFD, 0xFFFE))
#: Class symbols stand for all characters of a block outside _OWN; each ends where the next begins.
_BLOCKS = np.array([0x0, 0x250, 0x530, 0x2600, 0x2E80, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD800, 0xFF00, 0x10000, 0x20000])
_CLASS0 = 0x110000


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """Number of each code point's symbol, and the symbols by number: code points of own blocks, then the classes of blocks."""
    codes = np.arange(0x110000)
    own = np.zeros(len(codes), bool)
    for a, b in _OWN:
        own |= (codes >= a) & (codes < b)
    symbol = np.where(own, codes, _CLASS0 + np.searchsorted(_BLOCKS, codes, side="right"))
    by_number, number = np.unique(symbol, return_inverse=True)
    return number.astype(np.int32), by_number


_NUMBER, _SYMBOL = _symbol_tables()


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point: itself in an own block, else its block's class."""
    return _SYMBOL[_NUMBER[codes]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _garbled() -> re.Pattern:
    """Letters whose bytes are a sequence of UTF-8 in the two most common one-byte readings."""
    at = lambda a, b: "".join(re.escape(c) for r in ("latin-1", "cp1252") for n in range(a, b) for c in [bytes([n]).decode(r, "ignore")] if c)
    more = f"[{at(0x80, 0xC0)}]"
    return re.compile(f"[{at(0xC2, 0xE0)}]{more}|[{at(0xE0, 0xF0)}]{more}{{2}}|[{at(0xF0, 0xF5)}]{more}{{3}}")


_GARBLED = _garbled()


def count_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, a, b, n): kind 0 counts symbol pairs in all documents, kind 1 characters that only have a class symbol."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [t for t in b.column(0).to_pylist() if t]
        if not texts:
            return None
        # what reads as UTF-8 is no evidence of how clean text goes
        c = _codes(_GARBLED.sub(" ", " " + "  ".join(texts) + " "))
        k = _NUMBER[c]
        counts = np.bincount(k[:-1].astype(np.int64) * len(_SYMBOL) + k[1:])
        pairs = np.flatnonzero(counts)
        n = counts[pairs]
        shared = np.bincount(c[_SYMBOL[k] >= _CLASS0])
        chars = np.flatnonzero(shared)
        m = shared[chars]
        kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(chars), np.int32)])
        cols = (kind, np.concatenate([_SYMBOL[pairs // len(_SYMBOL)], symbols(chars)]), np.concatenate([_SYMBOL[pairs % len(_SYMBOL)], chars]), np.concatenate([n, m]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "a", "b", "n"])

    each = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), count, "kind int, a bigint, b bigint, n bigint")
    return each.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class CleanModel:
    """log P(character | character before) by interpolated bigrams of symbols."""

    def __init__(self, counts: pd.DataFrame):
        pairs = counts[counts.kind == 0]
        chars = counts[counts.kind == 1]
        total = max(1, int(pairs.n.sum()))
        self.one = {int(k): int(v) for k, v in pairs.groupby("b").n.sum().items()}
        self.first = {int(k): int(v) for k, v in pairs.groupby("a").n.sum().items()}
        self.two = {(int(a), int(b)): int(n) for a, b, n in zip(pairs.a, pairs.b, pairs.n)}
        self.total, self.memo = total, {}
        in_class = chars.groupby("a").n.sum().to_dict()
        self.char = {chr(int(b)): math.log((n + 0.2) / (in_class[a] + 2000)) for a, b, n in zip(chars.a, chars.b, chars.n)}
        self.new = {int(a): math.log(0.2 / (n + 2000)) for a, n in in_class.items()}
        per = {}
        for k, n in [*self.one.items(), *((int(b), int(n)) for b, n in zip(chars.b, chars.n))]:
            per[k] = per.get(k, 0) + n
        self.within = [math.log(WITHIN_SCRIPT * NEW_SCRIPT / (NEW_SCRIPT + sum(n for k, n in per.items() if a <= k < b))) for a, b in SCRIPTS]
        self.place: dict[str, tuple[int, int]] = {}

    def _place(self, c: str) -> tuple[int, int]:
        """(symbol, script or -1) of a character."""
        got = self.place.get(c)
        if got is None:
            o = ord(c)
            got = self.place[c] = (int(symbols(np.array([o]))[0]), next((k for k, (a, b) in enumerate(SCRIPTS) if a <= o < b), -1))
        return got

    def step(self, a: str, b: str) -> float:
        """log P(b | a)."""
        key = (a, b)
        got = self.memo.get(key)
        if got is None:
            (x, _), (y, script) = self._place(a), self._place(b)
            unigram = (self.one.get(y, 0) + 0.01) / (self.total + 30)
            if y < 0x180 or 0x2010 <= y < 0x2040:
                unigram = max(unigram, RARE)
            k = 4.0
            got = math.log((self.two.get((x, y), 0) + k * unigram) / (self.first.get(x, 0) + k))
            if y >= _CLASS0:
                got += self.char.get(b, self.new.get(y, -7.6))
            if script >= 0 and (inside := self._place(a)[1] == script) | (not a.isalpha()):
                got = max(got, self.within[script] - (0 if inside else FIRST))
            if len(self.memo) > 500_000:
                self.memo = {}
            self.memo[key] = got
        return got

    def score(self, text: str) -> float:
        """log P of all characters but the first, in order; a character that is never clean costs 30."""
        total, step, known = 0.0, self.step, self.memo.get
        for pair in zip(text, text[1:]):
            b = pair[1]
            if b == "�" or "\x7f" <= b < "\xa0":
                total -= 30.0
            elif (v := known(pair)) is not None:
                total += v
            else:
                total += step(*pair)
                known = self.memo.get  # a full memo starts anew
        return total


@lru_cache(maxsize=None)
def _bytes_of(read_with: str) -> dict[str, int]:
    """Byte of each character under an encoding; bytes it leaves undefined read as control characters, or were replaced."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(read_with)
        except UnicodeDecodeError:
            c = chr(b)
            out.setdefault("�", b)
        out.setdefault(c, b)
    return out


def inverse(text: str, state: tuple[str, str, int]) -> tuple[str, float] | None:
    """What a state's inverse transform makes of a text, and the cost of what is not sure in it; None if it cannot have come from it."""
    written, read, times = state
    table, cost = _bytes_of(read), GUESSED * text.count("�")
    for _ in range(times):
        try:
            raw = bytes([table[c] for c in text])
        except KeyError:
            return None
        got = _decoded(raw, written, cost)
        if got is None:
            return None
        text, cost = got
    return text, cost


_MULTIBYTE = frozenset(("utf-8", "cp932", "euc_jp", "gbk", "big5", "euc_kr"))


def _decoded(raw: bytes, written: str, cost: float) -> tuple[str, float] | None:
    """Bytes in an encoding, with the cost of what is not sure; `cost` is that of bytes that were guessed."""
    if cost and written not in _MULTIBYTE:
        return None  # nothing around a lost single byte tells which it was
    try:
        return raw.decode(written), cost
    except UnicodeDecodeError:
        text = raw.decode(written, "replace")
        broken = text.count("�")
        text = text.replace("�", "")
        if broken >= sum(c > "\x7f" for c in text):
            return None
        return text, cost + BROKEN * broken


_TWO_ALPHABETS = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u06ff\u0e00-\u0e7f]|[\u0370-\u06ff\u0e00-\u0e7f][A-Za-z\u00c0-\u024f]")


def restore(text: str, start: int, stop: int, state: int) -> tuple[int, str | None]:
    """(end, original) of a labelled span; None where it cannot be restored, or would give words of two alphabets. Its last character may
    end on a byte that reads as ASCII."""
    if state < 0:
        return stop, None
    for end in (stop, stop + 1) if STATES[state][0] in ("cp932", "gbk", "big5") and stop < len(text) else (stop,):
        made = inverse(text[start:end], STATES[state])
        if made and not made[1] and not _TWO_ALPHABETS.search(text[max(0, start - 1) : start] + made[0] + text[end : end + 1]):
            return end, made[0]
    return stop, None


#: Cost of entering each state by number; the last, -1, is the lost state's.
_COSTS = [enter_cost(s) for s in (*STATES, None)]
_readable = {r: set(_bytes_of(r)) for r in READ_WITH}
_any = set().union(*_readable.values())
#: Characters that a damaged or lost state may have made.
_wrong = {c for c in _any if c > "\x7e"} | {"\ufffd"}
#: Characters of a reading that are no ASCII, and those whose bytes may begin a sequence of UTF-8.
_beyond_ascii = {r: {c for c in x if c > "\x7f"} for r, x in _readable.items()}
_leads = {r: {c for c in x if 0xC2 <= _bytes_of(r)[c] <= 0xF4} for r, x in _beyond_ascii.items()}


def _pieces(text: str) -> list[tuple[int, int]]:
    """Runs that the model labels: outside ASCII, split where characters that some single-byte encoding has meet others."""
    out = []
    for m in _RUN.finditer(text):
        at, end = m.span()
        start, kind = at, text[at] in _any
        for i in range(at + 1, end):
            if (k := text[i] in _any) != kind:
                out.append((start, i))
                start, kind = i, k
        out.append((start, end))
    return out


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|(?:\xe0[\xa0-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]|\xed[\x80-\x9f])[\x80-\xbf]|(?:\xf0[\x90-\xbf]|[\xf1-\xf3][\x80-\xbf]|\xf4[\x80-\x8f])[\x80-\xbf]{2}")
_EDGES = re.compile(f"^([{PUNCTUATION}]*)(.*?)([{PUNCTUATION}]*)$", re.DOTALL)
#: What the states of a reading have in common: their numbers by the encoding they were written in, read once.
_BY_READ = {r: [(i, s) for i, s in enumerate(STATES) if s[1] == r and s[2] == 1] for r in READ_WITH}
_UTF8_OF = {r: i for r, states in _BY_READ.items() for i, s in states if s[0] == "utf-8"}
_TWICE = [(i, s) for i, s in enumerate(STATES) if s[2] == 2]

_STAY: dict = {None: None}

Spans = tuple[tuple[int, int], ...]


class Labeller:
    """Labels texts with a clean model; emissions of short runs are remembered within a bound."""

    def __init__(self, model: CleanModel):
        self.model, self.memo, self.known = model, {}, {}

    def candidates(self, run: str) -> tuple[float, list[tuple]]:
        """What a run has in common wherever it stands: the clean score inside it, and for each text that states make of it or of what lies
        between right punctuation at its ends (new run, its score inside, cost, part, whether the part became a letter, states, text)."""
        got = self.known.get(run)
        if got is not None:
            return got
        chars, score = set(run), self.model.score
        lead, core, tail = _EDGES.match(run).groups() if len(run) > 1 else ("", "", "")
        cores = {(a, b) for a in (0, len(lead)) for b in (len(run), len(run) - len(tail))} if core else {(0, len(run))}
        texts: dict[tuple, list[int]] = {}

        def put(made: tuple[str, float] | None, part: tuple[int, int], state: int) -> None:
            if made and made[0] and made[0] != run[part[0] : part[1]]:
                texts.setdefault((*made, *part), []).append(state)

        for read in READ_WITH:
            if chars.isdisjoint(_beyond_ascii[read]):
                continue
            table = _bytes_of(read)
            for a, b in cores:
                part = run[a:b]
                if set(part) <= _readable[read]:
                    raw, guessed = bytes([table[c] for c in part]), GUESSED * part.count("\ufffd")
                    for i, state in _BY_READ[read]:
                        put(_decoded(raw, state[0], guessed), (a, b), i)
        for i, state in _TWICE:
            if chars <= _readable[state[1]]:
                put(inverse(run, state), (0, len(run)), i)
        out = []
        for (text, cost, a, b), states in texts.items():
            new = run[:a] + text + run[b:]
            out.append((new, score(new), cost, (a, b), text[0].isalpha() and not run[a].isalpha(), states, text))
        got = (score(run), out)
        if len(run) <= 24:
            if len(self.known) > 50_000:
                self.known = {}
            self.known[run] = got
        return got

    def _along(self, left: str, run: str, right: str, raw: bytes) -> tuple[float, Spans, str] | None:
        """Best labelling, character by character, of a run whose bytes are partly UTF-8: (value, damaged spans, text), with at least one span."""
        units = {m.start(): m.end() for m in _UTF8.finditer(raw)}
        step, n = self.model.step, len(run)
        # two states a position: clean and damaged; each has (value, last character, spans, text)
        ways: list[list[tuple | None]] = [[None, None] for _ in range(n + 1)]
        ways[0][0] = (0.0, left, (), "")
        for i in range(n):
            for k, way in enumerate(ways[i]):
                if way is None:
                    continue
                v, last, spans, text = way
                c = run[i]
                clean = v - (LEAVE if k else 0) + (-30.0 if c == "\ufffd" or "\x7f" <= c < "\xa0" else step(last, c))
                if ways[i + 1][0] is None or ways[i + 1][0][0] < clean:
                    ways[i + 1][0] = (clean, c, spans, text + c)
                if i in units:
                    j, c = units[i], raw[i : units[i]].decode("utf-8", "replace")
                    bad = v - (ENTER - SPECIFIC if not k and spans else 0) + step(last, c)
                    if ways[j][1] is None or ways[j][1][0] < bad:
                        ways[j][1] = (bad, c, (*spans[:-1], (spans[-1][0], j)) if k and spans else (*spans, (i, j)), text + c)
        ends = [(v + step(last, right) - (LEAVE if k == 0 else 0), spans, text) for k, way in enumerate(ways[n]) if way for v, last, spans, text in [way] if spans]
        return max(ends) if ends else None

    def emissions(self, left: str, run: str, right: str) -> tuple[float, dict[int, tuple[float, Spans, str]]]:
        """Log-likelihood of a run under the clean state; and under each damaged state that could have made it or a part of it (-1: lost),
        with the parts and the text they make."""
        key = (left, run, right)
        got = self.memo.get(key)
        if got is not None:
            return got
        chars = set(run)
        if chars.isdisjoint(_wrong):
            return 0.0, {}  # only the clean state can have made it, whatever its likelihood
        score = step = self.model.score
        whole = ((0, len(run)),)
        inside, made = self.candidates(run)
        clean, out = step(left + run[0]) + inside + step(run[-1] + right), {}
        least = clean - 2 * ENTER
        for new, inner, cost, (a, b), letter, states, text in made:
            value = step(left + new[0]) + inner + step(new[-1] + right) - cost
            if letter and not ((run[a - 1] if a else left).isalpha() or (run[b] if b < len(run) else right).isalpha()):
                value -= ALONE
            if value > least:
                for i in states:
                    if i not in out or out[i][0] < value:
                        out[i] = (value, ((a, b),), text)
        if len(run) > 1:
            for read in READ_WITH:
                if not chars.isdisjoint(_leads[read]):
                    table = _bytes_of(read)
                    raw = bytes([table[c] if c in table and c != "\ufffd" else 63 for c in run])
                    i = _UTF8_OF[read]
                    if _UTF8.search(raw) and (best := self._along(left, run, right, raw)) and best[0] > max(least, out[i][0] if i in out else -math.inf):
                        out[i] = best
        if "\ufffd" in run or any("\x7f" <= c < "\xa0" for c in run):
            lost = [c for c in run if not (c == "\ufffd" or "\x7f" <= c < "\xa0")]
            out[-1] = (score(left + "".join(lost) + right) - LOST * (len(run) - len(lost)), whole, "")
        got = (clean, out)
        if len(run) <= 24:
            if len(self.memo) > 200_000:
                self.memo = {}
            self.memo[key] = got
        return got

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(start, stop, state, sure) of each damaged span, by the cheapest path through the runs of a text."""
        runs = _pieces(text)
        best: dict[int | None, float] = {None: 0.0}
        back: list[dict] = []
        emitted: list[dict[int, tuple[float, Spans, str]]] = []
        seen = False
        for a, b in runs:
            clean, others = self.emissions(text[a - 1] if a else " ", text[a:b], text[b] if b < len(text) else " ")
            if not others and len(best) == 1:  # clean before and here
                best[None] += clean
                back.append(_STAY)
                emitted.append(others)
                continue
            seen = seen or bool(others)
            now, came = {}, {}
            arrive, source = best[None], None
            for s, v in best.items():
                if s is not None and v - LEAVE > arrive:
                    arrive, source = v - LEAVE, s
            now[None], came[None] = arrive + clean, source
            top = max(best, key=best.get)
            for s, (e, _, _) in others.items():
                v, source = best[top] - _COSTS[s] - (CHANGE if top is not None else 0), top
                if s in best and best[s] > v:
                    v, source = best[s], s
                now[s], came[s] = v + e, source
            best = now
            back.append(came)
            emitted.append(others)
        if not seen:
            return []
        s = max(best, key=best.get)
        labels = []
        for came in reversed(back):
            labels.append(s)
            s = came[s]
        labels.reverse()
        out: list[tuple[int, int, int, bool]] = []
        at = 0
        while at < len(runs):
            label, to = labels[at], at
            while to + 1 < len(runs) and labels[to + 1] == label:
                to += 1
            if label is not None:
                sure = label >= 0 and self._sure(label, emitted[at : to + 1])
                fresh = True  # a span goes on over runs that are damaged from end to end
                for (a, b), others in zip(runs[at : to + 1], emitted[at : to + 1]):
                    parts = others[label][1]
                    for x, y in parts:
                        if not fresh and x == 0:
                            out[-1] = (out[-1][0], a + y, label, sure)
                        else:
                            out.append((a + x, a + y, label, sure))
                        fresh = y != b - a
            at = to + 1
        return out

    def _sure(self, label: int, emitted: list[dict[int, tuple[float, Spans, str]]]) -> bool:
        """Whether no other state that gives another text is about as likely over all runs of a span."""
        own = sum(x[label][0] for x in emitted) - _COSTS[label]
        texts = [x[label][2] for x in emitted]
        for s in set(emitted[0]).intersection(*emitted[1:]) - {label, -1}:
            if sum(x[s][0] for x in emitted) - _COSTS[s] > own - SURE and [x[s][2] for x in emitted] != texts:
                return False
        return True


_held: list[Labeller] = []


def damaged_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each damaged span: doc_id, start, stop, written_in, read_with, damaged, restored_text, restored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(CleanModel(count_pairs(docs, text_col).toPandas()))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))

    def label(b: pa.RecordBatch) -> pa.RecordBatch:
        if not _held or _held[0].model is not shared.value:
            _held[:] = [Labeller(shared.value)]
        tool, out = _held[0], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for start, stop, state, sure in tool.spans(text):
                stop, made = restore(text, start, stop, state) if sure else (stop, None)
                written, read = STATES[state][:2] if state >= 0 else (None, None)
                out.append((i, start, stop, written, read, text[start:stop], made, made is not None))
        cols = list(zip(*out)) if out else [[] for _ in range(8)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in SPANS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_batches(rows, label, SPANS)
