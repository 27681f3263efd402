import math
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import entities, qa, structure


def values(spark, rows, expr, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1).select(expr).collect()]


def test_estimated_tokens_counts_code_points(spark):
    texts = ["", "a", "abcd", "abcde", "日本語文章", "👩" * 5, "x" * 4800, None]
    assert values(spark, texts, T.estimated_tokens("a")) == [None if t is None else 0 if not t else max(1, math.ceil(len(t) / 4)) for t in texts]


def test_keeps_source(spark):
    texts = ["* * *", "12 : 45", "https://a.b/c", "see https://a.b/c", "Ünder", "  www.x.y  ", ""]
    assert values(spark, texts, T.keeps_source("a")) == [True, True, True, False, False, True, True]


def test_core_words_and_display(spark):
    names = ["Subaru-kun", "Mr. Subaru", "Lady Roxy", "kun", "Mr Dr", "Sir Lancelot sama", "Roxy", "", "san-kun"]
    assert values(spark, names, F.array_join(T.core_words("a"), " ")) == ["subaru", "subaru", "roxy", "kun", "dr", "lancelot", "roxy", "", "san"]
    assert values(spark, ["Lady Roxy", "Subaru-kun", "Mr. Dr. House san", "Roxy"], T.display_name("a")) == ["Roxy", "Subaru", "House", "Roxy"]


def test_contains_word_boundaries(spark):
    rows = [("ann went", "ann"), ("hannah", "ann"), ("éann", "ann"), ("ann's", "ann"), ("a.b", "a.b"), ("axb", "a.b")]
    assert values(spark, rows, T.contains_word(F.col("a"), F.col("b")), "a string, b string") == [True, False, False, True, True, False]


def test_paths_json_titles_backoff(spark):
    assert values(spark, ["../img/./a.png", "x//y", "../../../z"], T.resolved_path(F.lit("OEBPS/text"), F.col("a"))) == ["OEBPS/img/a.png", "OEBPS/text/x/y", "z"]
    assert values(spark, ['```json\n{"a": 1}\n```', '{"a": 1}'], T.unfenced_json("a")) == ['{"a": 1}'] * 2
    pairs = [("Chapter 1: X", "Chapter 1: X (Y)"), ("Chapter 1: X", "Bab 1"), ("Chapter 1: X", "Chapter 2: X (Y)"), ("Chapter 1: X", "Chapter 1: X"), ("Chapter 1: X", "Chapter 1: X ()"), ("Chapter 1: X", "Chapter 1: X (Chapter 1)"), ("X", "Y")]
    assert values(spark, pairs, T.title_error(F.col("a"), F.col("b")), "a string, b string") == [None, "prefix", "number", "parenthesis", "empty", "label", None]
    assert values(spark, ["Chapter 12", "Chapter 12: X"], T.label_title(F.col("a"))) == ["Chapter 12 (Bab 12)", None]
    assert values(spark, [(None, 1), (None, 9), (7, 2)], T.backoff_seconds(F.col("a"), F.col("b")), "a int, b int") == [4.0, 60.0, 7.0]
    assert values(spark, ["a.PNG", "b.jpeg", "c"], T.media_type("a")) == ["image/png", "image/jpeg", "application/octet-stream"]


def test_safe_titles(spark):
    assert values(spark, ['a: "b" / c', " ?* "], T.safe_title("a")) == ["a b c", "novel"]


def test_ranges(spark):
    assert values(spark, ["3", "2-5", "2,5,7-8", "8-2", "x", ""], structure.parse_ranges(F.col("a"))) == [[3], [2, 3, 4, 5], [2, 5, 7, 8], None, None, None]


def test_english_sentences_leave_short_quotes_and_urls_out(spark):
    lines = ["Ini kalimat.", "This is what you want to do.", 'Dia membaca "the art of the deal and you" keras.', 'Dia: "You are not what I want, you know."', "https://the.and/you-to-of it", "The and."]
    assert values(spark, lines, qa.english_sentence(F.col("a"))) == [False, True, False, True, False, False]


def test_qa_rules(spark):
    pairs = [("a\nb", ""), ("a\nb", "x"), ("a\nb", "x\n"), ("a\n\nb", "x\n\ny"), ("a", "Note: x"), ("a", "x -> y"), (None, None)]
    rules = values(spark, pairs, F.transform(qa.issues(F.col("a"), F.col("b")), lambda i: i["rule"]), "a string, b string")
    assert rules == [["translation_not_empty", "paragraph_count"], ["paragraph_count"], ["empty_paragraph"], [], ["unexpected_model_text"], ["source_echo"], ["translation_not_empty"]]
    named = [("Ann met Bob", "Ann bertemu dia", ["Ann", "Bob", "Cy"])]
    assert values(spark, named, F.transform(qa.issues(F.col("a"), F.col("b"), F.col("c")), lambda i: i["message"]), "a string, b string, c array<string>") == [["missing Bob"]]


def test_evidence_thresholds(spark):
    rows = [("Ann Lee", "Ann Lee wiki", "x", "https://a.b", "web", "Ann Lee character"), ("Ann Lee", "Lee met Ann", "", "", "", ""), ("Ann Lee", "Annlee", "text", "http://a", "web", "Ann Lee")]
    score = entities.evidence_score(*(F.col(c) for c in "abcdef"))
    assert values(spark, rows, score, "a string, b string, c string, d string, e string, f string") == [1.0, 0.5, 0.4]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB  \t\n 　é1-", max_size=12), min_size=1, max_size=20))
def test_normal_name_is_python_normalisation(spark, texts):
    want = [re.sub(r"\s+", " ", t).strip().lower() for t in texts]
    assert values(spark, texts, T.normal_name("a")) == [unicodedata.normalize("NFC", w) for w in want]
