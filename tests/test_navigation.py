from pyspark.sql import functions as F

from foliant.functions import markup as M
from foliant.operators import navigation as N


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_markup(spark):
    assert one(spark, M.mark_indonesian(F.lit('<html lang="en-US" xml:lang="en"><p lang="fr">'))) == '<html lang="id" xml:lang="id"><p lang="fr">'
    assert one(spark, M.repaired(F.lit('<img src="a.png" alt="x/><br/>'))) == '<img src="a.png" alt="x"/><br/>'
    assert one(spark, M.repaired(F.lit('<img src="a.png"/>'))) == '<img src="a.png"/>'
    assert one(spark, M.centered_images(F.lit('<img src="a"/><img style="x" src="b"/>'))).count("margin") == 2
    assert one(spark, M.centered_images(F.lit('<img src="b" style="x"/>'))) == f'<img src="b" style="{M.IMAGE_STYLE};x"/>'
    assert one(spark, M.chapter_label(F.lit("Extra Chapter: Malam"))) == "Extra Chapter" and one(spark, M.chapter_label(F.lit("Bab 3"))) == "" and one(spark, M.repairs(F.lit('<a b="c/><a b="c"/>'))) == 1
    assert one(spark, M.stylesheet_links(F.lit('<link rel="stylesheet" href="a.css"/><link href="b.css" rel="alternate stylesheet"><link rel="icon" href="c">'))) == ["a.css", "b.css"]
    assert one(spark, M.chapter_label(F.lit("Bab 3: Malam"))) == "Bab 3" and one(spark, M.without_label(F.lit("Bab 3: Malam"))) == "Malam"
    assert [one(spark, M.truth(F.lit(v))) for v in (" YES", "on", "0", "no")] == [True, True, False, False] and one(spark, M.truth(F.lit(None).cast("string"))) is None
    assert [one(spark, M.share(F.lit(v))) for v in ("0.4", "7", "-1", "x", "NaN")] == [0.4, 1.0, 0.0, 0.0, 0.0]
    assert one(spark, M.valid_indices(F.array(*map(F.lit, (2, 0, 5, -1, 2))), F.lit(3))) == [2, 0]
    assert one(spark, M.spine_answer(F.lit(" Chapter "))) == "chapter" and one(spark, M.spine_answer(F.lit("poem"))) is None


def test_labels_titles_media_parts(spark):
    points = spark.createDataFrame([("d", 0, "a.x#f", "A"), ("d", 1, "b.x#g", "B"), ("d", 2, "c.x", "C")], "doc_id string, pos int, href string, label string")
    titles = spark.createDataFrame([("d", "a.x#f", "One"), ("d", "b.x", "Two")], "doc_id string, href string, title string")
    assert [(r.pos, r.label) for r in N.updated_labels(points, titles).orderBy("pos").collect()] == [(0, "One"), (1, "Two"), (2, "C")]
    p = spark.createDataFrame([("d", "x", 0, None, " "), ("d", "x", 1, 1, "Head"), ("d", "y", 2, None, "Text"), ("d", "z", 3, 1, "H")], "doc_id string, href string, pos int, heading_level int, text string")
    c = spark.createDataFrame([("d", "z", "Named")], "doc_id string, href string, title string")
    assert {r.href: r.title for r in N.titles_by_href(c, p).collect()} == {"x": "Head", "y": "Text", "z": "Named"}
    m = spark.createDataFrame([("d", "img/a.png"), ("d", "img/b.png")], "doc_id string, name string")
    pages = spark.createDataFrame([("d", '<img src="../img/a.png"/>')], "doc_id string, html string")
    assert [r.name for r in N.referenced_media(m, pages).collect()] == ["img/a.png"]
    man = spark.createDataFrame([("d", "c1"), ("d", "c2"), ("d", "css")], "doc_id string, item_id string")
    spine = spark.createDataFrame([("d", 0, "c1"), ("d", 1, "c2")], "doc_id string, pos int, idref string")
    a, b = N.book_part(spine.where("idref = 'c2'"), man, spine)
    assert sorted(r.item_id for r in a.collect()) == ["c2", "css"] and [r.idref for r in b.collect()] == ["c2"]


def test_starts_back_off_over_title_lines(spark):
    p = spark.createDataFrame([("d", i, t) for i, t in enumerate(["x", "The Long Night", "y", *["Chapter Two"] * 9, "The Dawn", "z"])], "doc_id string, pos int, text string")
    s = spark.createDataFrame([("d", 2, "The Long Night"), ("d", 13, "Chapter Two: The Dawn")], "doc_id string, start int, title string")
    assert sorted(r.start for r in N.backed_off_starts(s, p).collect()) == [1, 3]


def test_state_is_carried_in_order(spark):
    c = spark.createDataFrame([("b", 1, "y"), ("a", 1, "n"), ("a", 0, "m"), ("b", 0, "x")], "chapter_id string, chunk_no int, text string")
    got = {(r.chapter_id, r.chunk_no): r.state for r in N.carried(c, lambda s, row: (s or "") + row["text"]).collect()}
    assert got == {("a", 0): "m", ("a", 1): "mn", ("b", 0): "x", ("b", 1): "xy"}
