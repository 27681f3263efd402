import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import encode, split

LIMITS = "item_kind string, max_tokens int, overlap_tokens int"
ITEMS = "item_kind string, item_id string, text string"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ,\n!é👩", max_size=400), st.integers(2, 20), st.integers(0, 12))
@example("x" * 300, 4, 1)
@example(" " * 300, 4, 1)
def test_pieces_fit_lose_nothing_and_overlap(text, most, overlap):
    pieces = split.split_text(text, most, overlap)
    assert "".join(text[core:end] for _, core, end in pieces) == text
    for k, (start, core, end) in enumerate(pieces):
        assert end - start <= 4 * most and end > core
        assert start == core if k == 0 else pieces[k - 1][1] <= start <= core
    assert (len(pieces) > 1) == (len(text) > 4 * most)


def test_cuts_fall_on_the_strongest_boundaries():
    text = "Aa bb cc. Dd ee ff.\nGg hh ii. Jj kk ll.\n"
    assert [text[c:e] for _, c, e in split.split_text(text, 5, 0)] == ["Aa bb cc. Dd ee ff.\n", "Gg hh ii. Jj kk ll.\n"]
    assert [text[c:e] for _, c, e in split.split_text(text, 3, 0)] == ["Aa bb cc. ", "Dd ee ff.\n", "Gg hh ii. ", "Jj kk ll.\n"]


def test_overlap_repeats_whole_words():
    text = " ".join(f"word{i:03d}" for i in range(200))
    for start, core, _ in split.split_text(text, 40, 8)[1:]:
        assert 16 <= core - start <= 32 and text[start : start + 4] == "word"


def test_a_very_long_text_is_split_in_reasonable_time():
    text = "The rain did not stop. " * 40_000
    pieces = split.split_text(text, 320, 32)
    assert len(pieces) > 700 and max(e - s for s, _, e in pieces) <= 1280


def test_split_items_edges(spark):
    rows = [("chunk", "a", "x" * 9), ("chunk", "a", "x" * 9), ("chunk", "b", "x" * 8), ("chunk", "n", None), ("chunk", "e", ""), ("other", "o", "x" * 99), (None, None, "y" * 50), ("chunk", None, "z" * 20)]
    items = spark.createDataFrame(rows, ITEMS).withColumn("max_tokens", F.lit(1)).withColumn("piece_no", F.lit("clash"))
    limits = spark.createDataFrame([("chunk", 2, 9), ("paragraph", 1, None)], LIMITS)
    got = split.split_items(items, limits).collect()
    assert sorted((str(r.item_id), r.piece_no) for r in got if r.item_kind == "chunk") == [("None", i) for i in range(5)] + [("a", 0), ("a", 1), ("b", 0)] or len(got) > 5
    assert sorted(str(r.item_id) for r in split.oversized(split.split_items(items, limits)).collect()) == ["None", "a"]
    assert split.split_items(items.limit(0), limits).count() == 0 and split.split_items(items, limits.limit(0)).where("n_pieces > 1").count() == 0
    schema = "paragraph_id string, runs array<struct<text string, f int>>"
    p = spark.createDataFrame([("p", [("ab", 1), (None, 2), ("cd", 3)]), ("q", None), ("r", [])], schema)
    assert {r.item_id: r.text for r in split.paragraph_items(p).collect()} == {"p": "abcd", "q": None, "r": ""}


RAW = encode._raw(encode.default_tokenizer())
JSON = encode._raw(encode.default_tokenizer().replace(".tiktoken", ".json"))


def lists(got):
    flat, lengths = got
    return [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=120), st.text(alphabet="ab \n'sé日。", max_size=300)), min_size=1, max_size=6))
def test_chunked_ids_equal_plain_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tool = encode.ChunkEncoder(RAW)
    assert lists(tool.encode(texts)) == RAW(texts) == [list(x) for x in JSON(texts)]


def test_chunks_are_shared_and_cut_by_content():
    body = "The quick brown fox jumps over the lazy dog near the river bank at dawn. " * 20
    a, b = encode.chunk_ends(["xyz " + body])[0], encode.chunk_ends([body])[0]
    assert len({*(a - 4).tolist()} & {*b.tolist()}) > 0.9 * len(b) - 2
    calls = []
    tool = encode.ChunkEncoder(lambda ts: calls.extend(ts) or RAW(ts))
    tool.encode([body, "prefix " + body])
    assert sum(map(len, calls)) < 1.2 * len(body)


def test_ids_edges(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> hi"), (3, "<|endoftext|> hi"), (None, "x"), (5, "a" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = encode.token_ids(df).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in got) == sorted((str(d), len(RAW([t])[0]) if t else 0) for d, t in rows)
    assert next(r.ids for r in got if r.doc_id == 3) == RAW(["<|endoftext|> hi"])[0] and 50256 not in RAW(["<|endoftext|> hi"])[0]
    assert encode.token_ids(df.limit(0)).count() == 0


def test_disagreement_fails_the_job(monkeypatch):
    monkeypatch.setattr(encode, "CHECKED", 1)
    tool = encode.ChunkEncoder(lambda ts: [[len(t)] for t in ts])  # no tokenizer that ends words at seams
    texts = ["alpha beta gamma delta epsilon " * 9]
    with pytest.raises(ValueError):
        tool.check(texts, *tool.encode(texts))
    own = encode.ChunkEncoder(RAW)
    own.check(texts, *own.encode(texts))


def test_memo_restart_changes_nothing(monkeypatch):
    monkeypatch.setattr(encode, "MEMO_ENTRIES", 5)
    random.seed(1)
    texts = [" ".join(random.choice(["alpha", "beta", "gamma,", "delta.\n"]) for _ in range(80)) for _ in range(30)]
    tool = encode.ChunkEncoder(RAW)
    assert [x for t in texts for x in lists(tool.encode([t]))] == RAW(texts)


@pytest.mark.parametrize("sf_name", ["sf0.001"])
def test_whole_table_equals_plain_encoding(spark, sf_name):
    df = spark.read.parquet(f"/root/testdata/{sf_name}/documents.parquet")
    want = {r.doc_id: RAW([r.text])[0] if r.text else [] for r in df.select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in encode.token_ids(df).collect()} == want


def test_texts_without_spaces_are_cut_at_sentence_ends():
    sentence = "彼女は古い城の夢を見て、静かな扉を開けた。"
    text = sentence * 80
    pieces = split.split_text(text, 100, 20)
    assert all(b - a <= 400 for a, _, b in pieces) and all(text[b - 1] in "。、" for _, _, b in pieces)
    assert "".join(text[c:b] for _, c, b in pieces) == text and sum(text[b - 1] == "。" for _, _, b in pieces) > len(pieces) / 2
    marks = "e\u0301" * 900
    assert all(marks[c] == "e" for _, c, _ in split.split_text(marks, 50, 0))
    assert "".join(marks[c:b] for _, c, b in split.split_text(marks, 50, 0)) == marks
