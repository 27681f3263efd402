import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import assemble, chunking, glossary, prefix, progress, stats, structure


def brute_pack(texts, limit):
    """Independent packing by joined strings."""
    out, now = [], []
    flush = lambda: (out.append("\n".join(now)), now.clear()) if now else None
    for t in texts:
        if t == "":
            flush()
            out.append("")
        elif -(-len(t) // 4) > limit:
            flush()
            out += chunking.word_pieces(t, limit)
        else:
            if now and -(-len("\n".join([*now, t])) // 4) > limit:
                flush()
            now.append(t)
    flush()
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), max_size=12), st.integers(2, 12))
def test_packer_matches_brute_force(texts, limit):
    p, got = chunking.Packer(limit), []
    for i, t in enumerate(texts):
        got += p.feed(str(i), t)
    got += p.end()
    assert ["\n".join(x[1]) for x in got] == brute_pack(texts, limit)
    assert all(size == -(-len("\n".join(x)) // 4) for _, x, size in got)


def test_word_pieces():
    assert chunking.word_pieces("   ", 3) == [""]
    assert chunking.word_pieces("aa bb  cc", 1) == ["aa", "bb", "cc"]
    assert chunking.word_pieces("a" * 50 + " b", 3) == ["a" * 50, "b"]


def test_pack_is_invariant_to_partitions(spark):
    random.seed(3)
    rows = [(f"d{d}", c, i, f"p{i}", random.choice([None, "", "x" * random.randrange(1, 200), "word " * 40])) for d in range(3) for c in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id string, chapter_no long, pos int, paragraph_id string, text string")
    one = sorted(map(str, chunking.pack(df, 30).collect()))
    random.shuffle(rows)
    two = sorted(map(str, chunking.pack(spark.createDataFrame(rows, df.schema).repartition(7), 30).collect()))
    assert one == two and len(one) > 20


def test_running_total_and_forward_fill_over_blocks(spark):
    random.seed(1)
    rows = [(f"k{random.randrange(3)}", i, random.randrange(5), random.choice([None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, n int, v string")
    got = {(r.k, r.i): (r.s, r.f) for r in prefix.forward_fill(prefix.running_total(df, ["k"], "i", F.col("n"), "s", block=7), ["k"], "i", "v", "f", block=11).collect()}
    total, last = {}, {}
    for k, i, n, v in rows:
        total[k] = total.get(k, 0) + n
        last[k] = v or last.get(k)
        assert got[k, i] == (total[k], last[k])


def test_heading_split_rules(spark):
    h = lambda pos, text: ("d", pos, f"p{pos}", None, 1, False, text)
    b = lambda pos, text: ("d", pos, f"p{pos}", None, None, False, text)
    schema = "doc_id string, pos int, paragraph_id string, idref string, heading_level int, all_bold boolean, text string"
    df = spark.createDataFrame([b(0, "pre"), h(1, "A"), h(2, "B"), b(3, "x"), b(4, "y"), h(5, "C"), b(6, "z"), h(7, "end")], schema)
    got = sorted((r.chapter_no, r.title, r.text) for r in structure.split_by_headings(df).collect())
    assert got == [(1, "d", "pre"), (2, "B", "x"), (2, "B", "y"), (3, "C", "z")]
    assert structure.split_by_headings(df.where("heading_level is null")).select("chapter_no").distinct().count() == 1
    assert structure.split_by_headings(df.limit(0)).count() == 0


def test_spine_classes(spark):
    schema = "doc_id string, pos int, paragraph_id string, idref string, heading_level int, all_bold boolean, text string"
    rows = [("d", 0, "a", "front", None, True, "My Book"), ("d", 1, "b", "head", 1, False, "One"), ("d", 2, "c", "odd", None, False, "some text"), ("d", 3, "e", "mark", None, True, "Chapter 3"), ("d", 4, "f", None, None, False, "x")]
    rows += [("d", 10 + i, f"l{i}", "long", None, False, "t") for i in range(9)]
    got = {r.idref: (r.classification, r.confidence) for r in structure.classify_spine(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"front": ("front_matter", 0.95), "head": ("chapter", 0.95), "odd": ("ambiguous", 0.5), "mark": ("chapter", 0.95), "long": ("chapter", 0.85)}


def test_story_flags_all_true_fallback(spark):
    df = spark.createDataFrame([("a", 1, "Cover"), ("a", 2, "Chapter 1"), ("b", 1, "Cover")], "doc_id string, chapter_no int, title string")
    assert sorted((r.doc_id, r.chapter_no, r.is_matter) for r in structure.story_flags(df, F.col("doc_id")).collect()) == [("a", 1, True), ("a", 2, False), ("b", 1, False)]


def test_glossary_replacement(spark):
    g = spark.createDataFrame([(1, "Lady", "Nona", True, False), (2, "Lady Ann", "Nyonya Ann", True, False), (3, "King’s Seal", "Segel Raja", True, False), (4, "Rudy", "Lady Ann", True, True), (5, "Off", "x", False, False), (6, "Lost", "Nowhere", True, True)],
                              "line_no int, term string, meaning string, active boolean, is_alias boolean")
    t = spark.createDataFrame([(1, "Lady Ann met lady Ann, Ladyship and King's Seal. Rudy Off"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.replaced for r in glossary.replace_terms(t, "text", glossary.resolve_aliases(g)).collect()}
    assert got == {1: "Nyonya Ann met lady Ann, Ladyship and Segel Raja. Nyonya Ann Off", 2: None, 3: ""}
    joined = {r.id: r.replaced for r in glossary.replace_terms(t, "text", glossary.resolve_aliases(g), limit=1).collect()}
    assert joined == got


def test_prune_and_containment(spark):
    df = spark.createDataFrame([(1, "Subaru-kun", "a"), (2, "Subaru", "b"), (3, "Mr. Subaru", "c"), (4, "Emilia Tan Rose", "d"), (5, "Tan Rose", "e"), (6, " ", "f")], "ord int, name string, kind string")
    pruned = glossary.prune_variants(df)
    assert sorted((r.core, r.name, r.kind) for r in pruned.collect()) == [("emilia tan rose", "Emilia Tan Rose", "d"), ("subaru", "Subaru", "b"), ("tan rose", "Tan Rose", "e")]
    assert sorted(r.core for r in glossary.not_contained(pruned).collect()) == ["emilia tan rose", "subaru"]


def test_latest_state_sticky_flags_and_status(spark):
    schema = "chapter_id string, chunk_id string, status string, qa_passed boolean, flagged boolean, saved_at timestamp_ntz"
    import datetime as dt
    t = lambda h: dt.datetime(2025, 1, 1, h)
    rows = [("c", "0", "in_progress", None, True, t(1)), ("c", "0", "completed", True, False, t(2)), ("c", "0", "in_progress", False, False, None), ("c", "1", "completed", False, False, t(1))]
    p = spark.createDataFrame(rows, schema)
    got = {r.chunk_id: (r.status, r.qa_passed, r.ever_flagged) for r in progress.latest_state(p).collect()}
    assert got == {"0": ("completed", True, True), "1": ("completed", False, False)}
    chunks = spark.createDataFrame([("c", str(i)) for i in range(8)] + [("e", "0")], "chapter_id string, chunk_id string")
    s = {r.chapter_id: (r.total, r.done, r.status, r.percent) for r in progress.chapter_status(chunks, p).collect()}
    assert s == {"c": (8, 1, "in_progress", 12), "e": (1, 0, "not_started", 0)}  # 12.5 rounds to even
    assert progress.pending(chunks, p).count() == 8


def test_cache_key_keeps_parts_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "a string, b string")
    assert df.select(progress.cache_key(F.col("a"), F.col("b")).alias("k")).distinct().count() == 4


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcé ", max_size=30), st.lists(st.integers(0, 9), max_size=6)), min_size=1, max_size=8))
def test_distribution_loses_nothing(spark, rows):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "i int, t string, n array<bigint>")
    for r in df.select("t", "n", assemble.distribute(F.col("t"), F.col("n")).alias("parts")).collect():
        assert len(r.parts) == len(r.n)
        assert not r.n or "".join(r.parts) == r.t


def test_completeness_and_merge(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "paragraph_id string"), spark.createDataFrame([("2",), ("3",)], "paragraph_id string")
    assert sorted(map(tuple, assemble.completeness(a, b).collect())) == [("1", "missing"), ("3", "unexpected")]
    parts = spark.createDataFrame([("k", 1, "b", ["y"], 2, True, False), ("k", 0, "a", ["x"], 1, True, True)], "k string, o int, translation string, paragraph_translations array<string>, attempts int, qa_passed boolean, flagged boolean")
    assert tuple(stats.merge_split(parts, ["k"], "o").first()) == ("k", "a\nb", ["x", "y"], 3, True, True)


def test_newest(spark):
    df = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1)], "k string, i int")
    assert sorted((r.k, r.i, r["rank"]) for r in prefix.newest(df, ["k"], [F.desc("i")], 2).collect()) == [("a", 298, 2), ("a", 299, 1), ("b", 1, 1)]


def test_rollup_counts_misses_only(spark):
    df = spark.createDataFrame([("c", "0", 3, True, False, False, []), ("c", "1", 5, True, False, True, []), ("d", "0", None, None, True, None, None)],
                               "chapter_id string, chunk_id string, attempts int, qa_passed boolean, flagged boolean, cache_hit boolean, issues array<string>")
    got = {r.chapter_id: (r.chunks, r.completed, r.attempts, r.retries) for r in stats.chapter_stats(df).collect()}
    assert got == {"c": (2, 2, 3, 2), "d": (1, 0, 0, 0), None: (3, 2, 3, 2)}


@pytest.mark.parametrize("status,selected,want", [("completed", True, "restore"), ("in_progress", True, "translate"), ("not_started", False, "skip")])
def test_action(spark, status, selected, want):
    assert spark.range(1).select(progress.action(F.lit(selected), F.lit(status))).first()[0] == want


def test_failure_reasons(spark):
    lines = ["start", "gagal early", "[1/2] Chapter: One ", "ok", "WARNING a", "  chunk GAGAL b ", "[2/2] Chapter: Two", "fine"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert [tuple(r) for r in progress.failure_reasons(df).collect()] == [("One", "chunk GAGAL b")]
