import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant import external
from foliant.operators import glossary, qa
from foliant.sinks import books
from foliant.sources import archives, state
from foliant.streaming import runs


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    run = "array<struct<text:string,formatting:struct<bold:boolean,italic:boolean,superscript:boolean,subscript:boolean,underline:boolean>>>"
    rows = [("b1", 1, "One", 0, 1, [("One", None)]), ("b1", 1, "One", 1, None, [("a <b> & ", (True, False, False, False, False)), ("c", (False, True, True, False, True))]), ("b1", 1, "One", 2, None, []), ("b1", 2, "Two", 3, 2, [("Two", None)])]
    df = spark.createDataFrame(rows, f"doc_id string, chapter_no int, title string, pos int, heading_level int, runs {run}")
    assert books.write_files(books.epub_files(books.chapter_pages(df)), str(folder), "epub") == 1
    return str(folder)


def test_epub_round_trip(spark, book):
    got = archives.read_paragraphs(spark, book).orderBy("pos").collect()
    assert [(r.pos, r.paragraph_id, r.text, r.heading_level, r.idref) for r in got if r.idref] == [(0, "p0000", "One", 1, "c0001"), (1, "p0001", "a <b> & c", None, "c0001"), (2, "p0002", "", None, "c0001"), (3, "p0003", "Two", 2, "c0002")]
    f = [r.formatting for r in got[1].runs]
    assert f[0].bold and not f[0].italic and f[1].italic and f[1].superscript and f[1].underline
    spine = archives.read_spine(spark, book).orderBy("pos").collect()
    assert [(r.idref, r.is_nav) for r in spine] == [("c0001", False), ("c0002", False)]
    assert {r.name: r.value for r in archives.read_metadata(spark, book).collect()}["title"] == "b1"
    assert qa.archive_issues(archives.read_members(spark, book), archives.read_manifest(spark, book), archives.read_spine(spark, book)).count() == 0


def test_archive_faults(spark):
    m = spark.createDataFrame([("d", 0, "x", 1, True, bytearray(b"")), ("d", 1, "mimetype", 1, False, bytearray(b"text"))], archives.MEMBERS)
    man = spark.createDataFrame([("d", "a", "a.x", "OEBPS/a.x", None, ""), ("d", "a", "x", "x", None, "")], archives.MANIFEST)
    spine = spark.createDataFrame([("d", 0, "zz", None, False)], archives.SPINE)
    rules = {r.rule for r in qa.archive_issues(m, man, spine).collect()}
    assert rules == {"MIMETYPE_FIRST", "MIMETYPE_UNCOMPRESSED", "MIMETYPE_VALUE", "CONTAINER_EXISTS", "OPF_DUPLICATE_MANIFEST_ID", "OPF_RESOURCE_EXISTS", "OPF_SPINE_REFERENCE"}


def test_docx_round_trip_and_headings(spark, tmp_path):
    runs_ = [{"text": "x ", "formatting": {"bold": True, "font_size": 11.5, "font_name": "Serif"}}, {"text": "y", "formatting": {"subscript": True}}]
    (tmp_path / "d.docx").write_bytes(books.docx_bytes([(1, [{"text": "A"}]), (None, runs_), (None, []), (1, [{"text": "B"}])]))
    (tmp_path / "one.docx").write_bytes(books.docx_bytes([(1, [{"text": "A"}]), (None, runs_)]))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    got = archives.read_paragraphs(spark, str(tmp_path)).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.text, r.heading_level) for r in got] == [("d", "A", 1), ("d", "x y", None), ("d", "", None), ("d", "B", 1), ("one", "A", None), ("one", "x y", None)]
    f = got[1].runs[0].formatting
    assert f.bold and f.font_size == 11.5 and f.font_name == "Serif" and got[1].runs[1].formatting.subscript
    with pytest.raises(ValueError):
        archives.read_paragraphs(spark, str(tmp_path / "a.pdf"))


def test_blocks_of_unclosed_markup():
    b = archives.page_blocks('<link rel="stylesheet" href="s.css"><h2 class="t">A &amp; <b>B</b></h2><p>one<p align=right>two <script>x</p></script>three')
    assert [("".join(t for t, _ in x["runs"]), x["level"], x["align"]) for x in b.out] == [("A & B", 2, None), ("one", None, None), ("two three", None, "right")] and b.links == ["s.css"]


def test_glossary_file_round_trip(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# a note\n## Karakter\nAnn = Anna\n~Annie = Ann\n# Off = Mati\nbad.left = x\nno pair\n## Tempat\nPort = \n", encoding="utf-8")
    g = state.read_glossary(spark, str(tmp_path / "g.txt"))
    assert [(r.section, r.term, r.meaning, r.active, r.is_alias) for r in g.orderBy("line_no").collect()] == [("Karakter", "Ann", "Anna", True, False), ("Karakter", "Annie", "Ann", True, True), ("Karakter", "Off", "Mati", False, False), ("Tempat", "Port", "", True, False)]
    found = spark.createDataFrame([("Off", "Karakter", "x"), ("Zed", "Karakter", "Z"), ("bee", "Karakter", "B"), ("Q", None, "q")], "name string, kind string, meaning string")
    text = books.glossary_text(glossary.merged_lines(g, found))
    assert re.search(r"## Karakter\n.*bee = B\nZed = Z\n", text, re.S) and "## lainnya\nQ = q" in text and text.count("Off") == 1


def test_progress_files_fall_back_to_backups(spark, tmp_path):
    chunk = {"translation": "t", "qa_passed": True, "attempts": 1}
    good = {"chapter_id": "c1", "status": "completed", "chunks": {"chunk_0000": chunk}}
    (tmp_path / "c1.json").write_text("{broken")
    (tmp_path / "c1.json.bak").write_text(json.dumps(good))
    (tmp_path / "c2.json").write_text(json.dumps({**good, "chapter_id": "c2"}))
    got = sorted((r.chapter_id, r.chunk_id, r.qa_passed) for r in state.read_progress(spark, str(tmp_path)).collect())
    assert got == [("c1", "chunk_0000", True), ("c2", "chunk_0000", True)]


def test_entity_file_versions(spark, tmp_path):
    for v in (1, 3, 9):
        (tmp_path / f"e{v}.json").write_text(json.dumps({"version": v, "characters": {f"Ann{v}": {"canonical_name": f"Ann{v}"}}, "proper_nouns": {}}))
    got = [(r.canonical_name, r.entity_type, r.aliases, r.locked, r.research) for r in state.read_entities(spark, str(tmp_path)).orderBy("canonical_name").collect()]
    assert got == [("Ann1", "character", [], False, []), ("Ann3", "character", [], False, [])]


def test_versioned_state_keeps_the_newest(spark, tmp_path):
    for v in range(4):
        books.write_versioned(spark.range(v), str(tmp_path / "s"), v, keep=2)
    assert books.newest_version(spark, str(tmp_path / "s")).count() == 3
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v")]) == 2


def test_failover(spark):
    def _models():
        def spent(prompt):
            raise external.Unavailable("Quota exceeded: requests per day")

        def echo(prompt):
            if "bad" in prompt:
                raise RuntimeError("refused")
            return prompt.upper()

        return [("first", spent), ("second", echo)]

    got = {r.prompt: (r.served_by, r.answer, r.error) for r in external.ask(spark.createDataFrame([("x",), ("bad",)], "prompt string").coalesce(1), _models).collect()}
    assert got["x"] == ("second", "X", None) and got["bad"][0] is None and "refused" in got["bad"][2]
    assert external.parse_chain("a:m1, m2 ,b:c:m3") == [("a", "m1"), ("", "m2"), ("b:c", "m3")]
    assert external.answer_json('```json\n{"a": [1]}\n```') == {"a": [1]}


def test_bisecting_keeps_one_translation_a_paragraph():
    def translate(model, ps):
        return [p.upper() for p in ps] if len(ps) < 3 else ps[:1]

    assert external.translate_chunk(None, list("abcde"), translate) == list("ABCDE")
    with pytest.raises(ValueError):
        external.translate_chunk(None, list("abcdefgh"), translate, depth=1)


def test_retry_passes(spark):
    chunks = spark.createDataFrame([(i,) for i in range(6)], "id int")
    done = external.retry_passes(chunks, lambda df, k: df.withColumn("translation", F.when(F.col("id") < 2 * k, "ok").otherwise("bad")), lambda df: df.withColumn("passed", F.col("translation") == "ok"), retries=1)
    assert sorted((r.id, r.attempts, r.passed, r.flagged) for r in done.collect()) == [(0, 1, True, False), (1, 1, True, False), (2, 2, True, False), (3, 2, True, False), (4, 2, False, True), (5, 2, False, True)]


def test_research_widens_and_stops(spark):
    from foliant.operators import model_calls as C

    def clients():
        return lambda q, n: [{"title": q, "source": "s"}] * 9, lambda name, q, found: [7, 0, 0, 99] if name == "Bob" or '"A"' in q else []

    got = {r.name: (r.query, r.n_queries, len(r.results)) for r in C.researched(spark.createDataFrame([("Ann", "place"), ("Bob", "poem")], "name string, kind string"), clients, "N", "A").collect()}
    assert got == {"Ann": ('"Ann" location "N" "A"', 2, 2), "Bob": ('"Bob" "N"', 1, 2)}


def test_model_policy():
    from foliant.operators.model_calls import Retrying

    seen = []
    answers = [(500, None, "x"), (429, 90.0, "busy"), (200, None, "ok")]
    client = Retrying(lambda p: answers[min(len(seen), 2)] if not seen.append(p) and False else answers[len(seen) - 1])
    assert client("p") == "ok" and (client.attempts, client.waited) == (3, 62.0)
    for status, body in ((429, "quota exceeded: requests per day"), (404, "no"), (503, "down")):
        client = Retrying(lambda p, s=status, b=body: (s, None, b))
        with pytest.raises(external.Unavailable):
            client("p")
        assert client.attempts == (3 if status == 503 else 1)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src = tmp_path / "src"
    events.write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    q = runs.usage_per_day(stream).writeStream.format("memory").queryName("usage").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.day, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.day, r.event_type): r.n for r in spark.table("usage").collect()} == want


def test_progress_stream_folds_to_latest(spark, tmp_path):
    schema = "chapter_id string, chunk_id string, status string, qa_passed boolean, flagged boolean, saved_at timestamp"
    import datetime as dt
    src = str(tmp_path / "p")
    rows = [("c", "0", "in_progress", None, True, dt.datetime(2025, 1, 1, 1)), ("c", "0", "in_progress", None, False, dt.datetime(2025, 1, 1, 1)), ("c", "0", "completed", True, False, dt.datetime(2025, 1, 1, 2))]
    for row in rows:
        spark.createDataFrame([row], schema).write.mode("append").parquet(src)
        runs.follow_progress(spark, spark.readStream.schema(schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    got = runs.states(spark, str(tmp_path / "t")).collect()
    assert [(r.status, r.qa_passed, r.ever_flagged) for r in got] == [("completed", True, True)]


def test_nothing_outside_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent / "foliant"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "foliant.llm" in p.read_text()]


def test_rebuilding_keeps_the_source_book():
    import io
    import zipfile

    page = '<html lang="en"><head><link rel="stylesheet" href="a.css"/></head><body><h1 class="t">One</h1><p>open<p class="x">two <b>bold</b></p><div><p></p></div><img src="i.png"/></body></html>'
    assert archives.replace_blocks(page, ["Satu", None, "dua", "tiga"]) == page.replace(">One<", ">Satu<").replace("two <b>bold</b>", "dua").replace("<p></p>", "<p>tiga</p>")
    data = books.epub_bytes("b", [(1, "One", page)], {"OEBPS/a.css": b"p{}", "OEBPS/i.png": b"png"})
    made = books._rebuilt(data, {0: "Satu", 2: "<strong>dua</strong>"}, {"": "Buku & B", "OEBPS/c0001.xhtml": "Bab 1"}, "id")
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert z.read("OEBPS/a.css") == b"p{}" and z.read("OEBPS/i.png") == b"png"
        text = z.read("OEBPS/c0001.xhtml").decode()
        assert '<h1 class="t">Satu</h1><p>open<p class="x"><strong>dua</strong></p>' in text and 'lang="id"' in text
        assert ">Bab 1</a>" in z.read("OEBPS/nav.xhtml").decode() and "<dc:title>Buku &amp; B</dc:title>" in z.read("OEBPS/content.opf").decode()


def test_damaged_archives_are_reported(spark, book, tmp_path):
    (tmp_path / "x.docx").write_bytes(b"no archive")
    (tmp_path / "y.epub").write_bytes(b"PK")
    assert sorted((r.doc_id, r.suffix) for r in archives.read_refused(spark, str(tmp_path)).collect()) == [("x", "docx"), ("y", "epub")]
    assert archives.read_refused(spark, book).count() == 0


def test_glossaries_of_a_folder_stay_apart(spark, tmp_path):
    (tmp_path / "a.txt").write_text("## S\nAnn = Anna\n~Annie = ann\nLine = x\n")
    (tmp_path / "b.txt").write_text("Bob = Bobby\n~Annie = Bob\n")
    g = state.read_glossary(spark, str(tmp_path))
    assert sorted((r.file[-5:], r.term, r.section) for r in g.collect()) == [("a.txt", "Ann", "S"), ("a.txt", "Annie", "S"), ("a.txt", "Line", "S"), ("b.txt", "Annie", None), ("b.txt", "Bob", None)]
    got = sorted((r.file[-5:], r.term, r.meaning) for r in state.active_terms(g).collect())
    assert got == [("a.txt", "Ann", "Anna"), ("a.txt", "Annie", "Anna"), ("a.txt", "Line", "x"), ("b.txt", "Annie", "Bobby"), ("b.txt", "Bob", "Bobby")]
    assert [r.term for r in state.editor_view(g.where("section = 'S'"), "alphabetical", search="AN").collect()] == ["Ann", "Annie"]


def test_progress_keeps_backups_and_reports_damage(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "0", "completed", "t", ["t"], 1, True, False, False)], "chapter_id string, chunk_id string, status string, translation string, paragraph_translations array<string>, attempts int, qa_passed boolean, flagged boolean, cache_hit boolean")
    folder = str(tmp_path / "p")
    assert books.save_progress(rows, folder) == 1 and books.save_progress(rows.withColumn("translation", F.lit("u")), folder) == 1
    assert state.read_progress(spark, folder).first().translation == "u"
    (tmp_path / "p" / "c1.json").write_text("{")
    assert state.read_progress(spark, folder).first().translation == "t" and state.damaged_progress(spark, folder).count() == 0
    (tmp_path / "p" / "c2.json").write_text("{")
    assert [r.file for r in state.damaged_progress(spark, folder).collect()] == ["c2"]
