import pytest
from pyspark.sql import functions as F

from foliant.llm import encoding as E

FR = "Après la bataille, il est revenu à la forêt où l’épée brûlée était cachée dans l’église."
RU = "Капитан спросил, кто украл кольцо прошлой ночью у старой реки."
JA = "彼女は古い城の夢を見て、泣きながら目を覚ました。"
ZH = "没有人知道他为什么把钥匙带到这里来。"
EN = "“I have never seen such a blue rope,” said Stíavol and left the wall."
CLEAN = [FR, RU, JA, ZH, EN, "plain words", "The sign read “ÂME” and below it “SÃO BRITO”.", "«Não», respondeu a irmã, «amanhã não há pão».", "5 € for №3, √2 ≥ 1 ☆ ⚔️", "¿Qué? ¡No!", "Smörgåsbord für Zoë"]


def read_as(text, written, read):
    table = {b: c for c, b in E._bytes_of(read).items() if c != "�"}
    return "".join(table[b] for b in text.encode(written))


DAMAGED = [
    (FR, "utf-8", "cp1252"), (FR, "utf-8", "latin-1"), (FR, "utf-8", "mac_roman"), (FR, "utf-8", "cp437"), (FR, "utf-8", "cp850"), (FR, "utf-8", "cp1250"), (FR, "utf-8", "cp1251"), (EN, "utf-8", "cp1252"),
    (RU, "utf-8", "cp1251"), (RU, "utf-8", "cp1252"), (RU, "cp1251", "latin-1"), (RU, "koi8-r", "latin-1"), (JA, "utf-8", "cp1252"), (JA, "euc_jp", "latin-1"), (JA, "cp932", "latin-1"), (ZH, "gbk", "latin-1"), (FR, "cp1252", "cp437"), (FR, "cp1252", "mac_roman"),
]


@pytest.fixture(scope="module")
def tool(spark):
    """The model counts the documents that it labels, so the unusual but right sentences are among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    own = spark.createDataFrame([(t,) for t in CLEAN] * 3, "text string")
    return E.Labeller(E.CleanModel(E.count_pairs(docs.unionByName(own)).toPandas()))


def restored(tool, text):
    out, at = "", 0
    for a, b, s, sure in tool.spans(text):
        b, got = E.restore(text, a, b, s) if sure else (b, None)
        out += text[at:a] + (got if got is not None else text[a:b])
        at = b
    return out + text[at:]


@pytest.mark.parametrize("text", CLEAN)
def test_right_characters_stay(tool, text):
    assert tool.spans(text) == []


@pytest.mark.parametrize("text,written,read", DAMAGED)
def test_damage_is_found_and_mostly_restored(tool, text, written, read):
    bad = read_as(text, written, read)
    assert tool.spans(bad)
    if (written, read) not in (("cp1252", "cp437"), ("cp1252", "mac_roman")):
        assert restored(tool, bad) == text


def test_partial_double_and_lost(tool):
    half = f"{EN} {read_as(FR, 'utf-8', 'cp1252')} {JA}"
    assert restored(tool, half) == f"{EN} {FR} {JA}"
    assert restored(tool, read_as(read_as(FR, "utf-8", "cp1252"), "utf-8", "cp1252")) == FR
    lost = FR.encode("cp1252", "replace").decode("utf-8", "replace")
    assert tool.spans(lost) and restored(tool, lost) == lost


def test_frames(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bad = read_as(FR, "utf-8", "cp1252")
    rows = [(-1, None), (-2, ""), (-3, bad), (-3, bad), (-4, EN), (None, bad), (-5, (EN + " ") * 4000 + bad)]
    df = base.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("damaged", F.lit("clash"))
    got = E.damaged_spans(df).where("doc_id < 0 or doc_id is null").collect()
    assert {r.doc_id for r in got} == {-3, -5, None} and all(r.restored and r.written_in == "utf-8" for r in got)
    assert E.damaged_spans(df.limit(0)).count() == 0


PL = "Święta więc zaczęły się późno, a żółta łódź została źle zamknięta."
EL = "Ο γέρος άνοιξε την πόρτα και κοίταξε τη θάλασσα."
TH = "เขาเดินไปที่แม่น้ำในตอนเช้า"
AR = "ذهب الرجل إلى المدينة القديمة في الليل"
CS = "Příliš žluťoučký kůň úpěl ďábelské ódy."


def test_damage_beside_right_characters(tool):
    for text, want in {
        "Il dit “Ã©tait tard”": "Il dit “était tard”", "La fin—Ã©tat": "La fin—état", "un cafÃ©… et rien": "un café… et rien", "«Ã€ bientÃ´t»": "«À bientôt»", "le prÃ©féré": "le préféré",
    }.items():
        assert restored(tool, text) == want, text
    assert tool.spans("Il dit “était” — «déjà vu»…") == []


@pytest.mark.parametrize("text,written,read", [(PL, "cp1250", "cp1252"), (EL, "cp1253", "cp1252"), (TH, "cp874", "cp1252"), (AR, "cp1256", "cp1252"), (CS, "iso8859-2", "latin-1"), (TH, "utf-8", "cp1252"), (EL, "utf-8", "cp1252")])
def test_scripts_that_documents_lack(tool, text, written, read):
    """Found, and never given another text than the right one as restored."""
    bad = read_as(text, written, read)
    spans = tool.spans(bad)
    assert spans
    for a, b, s, sure in spans:
        if sure:
            b, got = E.restore(bad, a, b, s)
            assert got is None or got in text, (bad[a:b], got)
