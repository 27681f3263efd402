"""One consistent form for texts whose characters only look like the usual ones.

Texts are taken apart into words (letters, marks, digits, symbols and invisible characters) and spaces other than the ordinary
one. Each distinct suspicious word is mapped once: invisible characters go, full-width letters and digits and ligatures become
plain, as do mathematical and letterlike forms, and letters of another script or of a phonetic alphabet become the Latin letter
they look like: in words with more Latin letters than letters that look unlike any, and in words of look-alikes only, unless they
stand among words of their own script. For that, a word of look-alikes is in its own script if letters of that script which look
unlike Latin are the nearest within REACH characters, with no Latin letter and no end of a sentence or quotation between, or stand
on both sides, or if the text has such letters and no Latin ones. The mapped words are grouped in SQL under the accent- and case-sensitive Unicode collation, which holds an accent apart from its letter and the precomposed
letter for equal; the shortest precomposed member of a class, the first in binary order among equals, is its canonical form and
is joined back to every word of the class.

Which letter looks like which is taken from the skeletons of the ICU library that Spark itself ships.

Defined results: null and empty texts stay and are no case; line ends and tabs are kept; repeated rows give one result each id;
curly quotes, dashes, precomposed accents, CJK punctuation, emoji with their joiners, and joiners inside Arabic and Indic words
are in order as they are; an accent without a precomposed letter stays apart; a text with the noncharacter U+FDD0 gets no look at
what stands around its words.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.session import cut

_SPACES = r"\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
_INVISIBLE = r"\u00AD\u034F\u180E\u200B\u200E\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF"
#: Characters that need no look: ASCII, precomposed Latin, general punctuation without its spaces and invisible characters.
_PLAIN = r"\x00-\x7E\u00A1-\u00AC\u00AE-\u024F\u1E00-\u1EFF\u2010-\u2027\u2030-\u205E"
_SUSPECT = f"[^{_PLAIN}]"
#: Stands before words of look-alikes in their own script while a text is taken apart.
_OWN_MARK = "\uFDD0"
_IN_WORD = r"\p{L}\p{M}\p{N}\p{So}\p{Cf}"
_TOKEN = rf"{_OWN_MARK}?[{_IN_WORD}]+|[{_SPACES}]+"
#: Characters on either side within which a word's neighbours tell its script, and what they are not looked for beyond.
REACH, _STOPS = 60, r".!?\u2026;:()\[\]{}\"\u201C-\u201F\u00AB\u00BB\n\r"
_JOINER = r"(^|[^\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\uFE0F\u200C\u200D])[\u200C\u200D]+"
_JOINING_SCRIPT = r"[\u0600-\u08FF\u0900-\u0DFF\u0E00-\u109F]"
_LATIN = r"[A-Za-z\u00AA\u00BA\u00C0-\u024F\u1E00-\u1EFF\uFF21-\uFF3A\uFF41-\uFF5A\uFB00-\uFB06]"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Scripts whose texts may have words of look-alikes only.
_SCRIPTS = ("Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic", "Lisu")
#: Letterlike symbols, Roman numerals, and mathematical letters and digits.
_FORMS = ((0x2100, 0x218B), (0x1D400, 0x1D7FF))
#: Blocks whose letters may stand for Latin ones: phonetic, Greek, Cyrillic, Armenian, Cherokee, phonetic extensions, Coptic, Lisu.
_BLOCKS = ((0x250, 0x2AF), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x13A0, 0x13FF), (0x1D00, 0x1D7F), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF))

_lookalikes: dict[str, str] = {}


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letters of _BLOCKS that share a skeleton with one plain Latin letter, by that letter (of the same case where both exist)."""
    if not _lookalikes:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        foreign = [chr(c) for a, b in _BLOCKS for c in range(a, b + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo")]
        latin = [chr(c) for c in (*range(65, 91), *range(97, 123))]
        skeletons = checker.getSkeleton("\n".join(latin + foreign)).split("\n")
        by: dict[str, list[str]] = {}
        for c, s in zip(latin, skeletons):
            by.setdefault(s, []).append(c)
        for c, s in zip(foreign, skeletons[len(latin) :]):
            if same := by.get(s):
                _lookalikes[c] = next((x for x in same if x.isupper() == c.isupper()), same[0])
        _lookalikes["ӏ"] = "l"  # ICU takes this small letter for an i, for its capital's sake
        for c in foreign:  # capitals that ICU folds apart from theirs take the capital of what their small letter looks like
            low = c.lower()
            if c.isupper() and c not in _lookalikes and unicodedata.normalize("NFKD", c) != c and low in _lookalikes:
                _lookalikes[c] = _lookalikes[low].upper()
            small = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, ""))
            if small:
                _lookalikes.setdefault(c, small[1].lower())
    return _lookalikes


def plain_forms() -> dict[str, str]:
    """Letters and digits that are forms of one or more ASCII ones, by those."""
    out = {}
    for a, b in _FORMS:
        for c in map(chr, range(a, b + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain.isascii() and plain.isalnum() and unicodedata.category(c) in ("Lu", "Ll", "Lo", "Nl", "Nd"):
                out[c] = plain
    return out


def _mapped(word: Column, look: dict[str, str]) -> Column:
    v = F.regexp_replace(word, f"^{_OWN_MARK}|[{_INVISIBLE}]", "")
    v = F.when(v.rlike(_JOINING_SCRIPT), v).otherwise(F.regexp_replace(v, _JOINER, "$1"))
    wide = {chr(c): chr(c - 0xFEE0) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
    forms = plain_forms()
    single = wide | {k: x for k, x in forms.items() if len(x) == 1}
    v = F.translate(v, "".join(single), "".join(single.values()))
    for a, b in {**_LIGATURES, **{k: x for k, x in forms.items() if len(x) > 1}}.items():
        v = F.replace(v, F.lit(a), F.lit(b))
    letters = "".join(look)
    latin = F.length(F.regexp_replace(v, "[^A-Za-z\\u00AA\\u00BA\\u00C0-\\u024F\\u1E00-\\u1EFF]", ""))
    own = F.length(F.regexp_replace(v, f"(?U)[\\P{{L}}{letters}A-Za-z\\u00AA\\u00BA\\u00C0-\\u024F\\u1E00-\\u1EFF]", ""))
    latinised = F.translate(v, letters, "".join(look.values()))
    v = F.when(v.rlike(f"[{letters}]") & ~word.startswith(_OWN_MARK) & ((own == 0) | (latin > own)), latinised).otherwise(v)
    return F.when(word.rlike(f"^[{_SPACES}]+$"), F.repeat(F.lit(" "), F.length(word))).otherwise(v)


def _marked(text: Column, look: dict[str, str]) -> Column:
    """A text with _OWN_MARK before each word of look-alikes that stands among words of its own script."""
    out, latin = text, "A-Za-z\\u00AA\\u00BA\\u00C0-\\u024F\\u1E00-\\u1EFF\\uFF21-\\uFF3A\\uFF41-\\uFF5A\\uFB00-\\uFB06"
    letters = "".join(look)
    for script in _SCRIPTS:
        own = f"\\p{{Is{script}}}&&\\p{{L}}&&[^{letters}]"
        word = f"(?<![{_IN_WORD}])(?:[\\p{{Is{script}}}&&[{letters}]][\\p{{M}}\\p{{Cf}}]*+)++(?![{_IN_WORD}])"
        before = lambda stops, own=own: f"(?<=[{own}][^{latin}{stops}]{{0,{REACH}}})"
        after = lambda stops, own=own: f"(?=[^{latin}{stops}]{{0,{REACH}}}[{own}])"
        around = "|".join((after(_STOPS), before(_STOPS), before("") + after("")))
        alone = text.rlike(f"[{own}]") & ~text.rlike(f"[{latin}]")
        mark = F.when(alone, F.regexp_replace(out, word, f"{_OWN_MARK}$0")).otherwise(F.regexp_replace(out, f"{word}(?:{around})", f"{_OWN_MARK}$0"))
        out = F.when(text.rlike(f"[{own}]"), mark).otherwise(out)
    return F.when(text.rlike(f"(?<![{_IN_WORD}])(?:[{letters}][\\p{{M}}\\p{{Cf}}]*+)++(?![{_IN_WORD}])") & ~text.contains(_OWN_MARK), out).otherwise(text)


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def suspects(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, word): the distinct suspicious words and spaces of each text; texts without any are not taken apart."""
    marked = _marked(F.col(text_col), lookalikes(texts.sparkSession))
    words = F.array_distinct(F.filter(F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0)), lambda w: w.rlike(_SUSPECT)))
    return texts.where(F.col(text_col).rlike(_SUSPECT)).select(*keys, F.explode(words).alias("word"))


def canonical_words(words: DataFrame) -> DataFrame:
    """(word, canonical) of those distinct words whose canonical form is another."""
    spark = words.sparkSession
    each = words.select("word").distinct().withColumn("mapped", _mapped(F.col("word"), lookalikes(spark)))
    plain = F.when(F.col("mapped").rlike(r"\p{M}"), _composed("mapped")).otherwise(F.col("mapped"))
    foreign_digits = F.regexp_replace("mapped", r"[^\p{Nd}]|[0-9]", "")  # the collation holds digits of all scripts for equal
    each = each.select("word", F.collate("mapped", "UNICODE").alias("key"), foreign_digits.alias("digits"), plain.alias("plain"))
    best = each.groupBy("key", "digits").agg(F.min(F.struct(F.length("plain").alias("n"), "plain")).alias("best"))
    return each.join(best, ["key", "digits"]).select("word", F.col("best.plain").alias("canonical")).where(F.ltrim(F.col("word"), F.lit(_OWN_MARK)) != F.col("canonical"))


def changed_ids(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Distinct keys of the texts with a word or space that is not in canonical form."""
    found = cut(suspects(texts, text_col, *keys))  # the texts are read once
    return found.join(canonical_words(found), "word").select(*keys).distinct()


def canonical_texts(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(keys, text_col, canonical): each distinct text with its canonical form. The keys and the text identify a row."""
    found = cut(suspects(texts, text_col, *keys, text_col))
    per = found.join(canonical_words(found), "word").groupBy(*keys, text_col).agg(
        F.map_from_entries(F.collect_set(F.struct("word", "canonical"))).alias("changed"))
    rows = texts.select(*keys, text_col).distinct()
    same = [rows[k].eqNullSafe(per[k]) for k in (*keys, text_col)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    t = _marked(rows[text_col], lookalikes(texts.sparkSession))
    words = F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))
    between = F.split(t, _TOKEN, -1)
    fixed = F.concat(F.array_join(F.zip_with(between, words, lambda b, w: F.concat(
        F.coalesce(b, F.lit("")), F.when(w.isNull(), "").otherwise(F.coalesce(F.element_at(per["changed"], w), F.ltrim(w, F.lit(_OWN_MARK)))))), ""))
    return rows.join(per, cond, "left").select(*[rows[k] for k in (*keys, text_col)], F.when(per["changed"].isNull(), rows[text_col]).otherwise(fixed).alias("canonical"))


def run_texts(paragraphs: DataFrame) -> DataFrame:
    """(item_kind, item_id, run_no, text) of the runs of paragraphs."""
    return paragraphs.select("paragraph_id", F.posexplode("runs").alias("run_no", "run")).select(
        F.lit("run").alias("item_kind"), F.col("paragraph_id").alias("item_id"), "run_no", F.col("run.text").alias("text"))


def term_texts(glossary: DataFrame) -> DataFrame:
    return glossary.select(F.lit("term").alias("item_kind"), F.col("line_no").cast("string").alias("item_id"), F.lit(0).alias("run_no"), F.col("term").alias("text"))
