"""Languages (p3), pair defects (p2) and sentence alignment (p5), with models fitted on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import align, langid, pairs

ID = "Pintu gerbang terbuka pada tengah malam, dan Veasen melihat sarung tangan biru itu."
EN = "The door of the castle opened at midnight, and the soldier saw the blue glove."
FR = "Le capitaine a demandé qui avait volé la clé cette nuit-là."
DE = "Die Schüler glaubten, dass dem Schwert für immer verloren wäre."
RU = "Капитан спросил, кто украл кольцо прошлой ночью."
JA = "彼女は古い城の夢を見て、泣きながら目を覚ました。"
ZH = "没有人知道他为什么把钥匙带到这里来。"


@pytest.fixture(scope="module")
def models(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def langs(models, text):
    return [s[2] for s in models.value.segments([text])[0]]


def test_sentences_and_mixed_texts(models):
    for text, lang in ((ID, "id"), (EN, "en"), (FR, "fr"), (DE, "de"), (RU, "ru"), (JA, "ja"), (ZH, "zh")):
        assert langs(models, text) == [lang]
        assert langs(models, text.upper()) == [lang]
    assert langs(models, f"{ID} {JA} {ID}\n{FR} {FR}") == ["id", "ja", "id", "fr"]
    s = models.value.segments([f"{ID} {DE}"])[0]
    assert (s[0][0], s[0][1], s[1][1]) == (0, len(ID), len(ID) + 1 + len(DE)) and all(0.9 <= x[4] <= 1 for x in s)


def test_what_has_no_language(models):
    for text in ("", "   ", "Jika...", "Veasen Praezilias", "https://serial.example/nv0000012/1234", "12 34 56 78", "* * *", "xqzw vkjq zzxw qqkj wvxz"):
        assert langs(models, text) == []


def test_models_on_held_out_documents(spark, models):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(text) > 200").collect()
    hits = [max(((n, l) for _, _, l, n, _ in models.value.segments([r.text])[0]), default=(0, ""))[1] == r.lang for r in rows]
    assert sum(hits) >= 0.9 * len(hits) > 30


def test_kneser_ney_is_a_distribution():
    m = langid.LanguageModels({"aa": ["abab abba baab abab"] * 3, "bb": ["cdcd dccd ccdd"] * 3})
    contexts = langid._PLAIN[langid._codes("   aba")]
    total = sum(np.exp(m.char_scores(np.append(contexts, c))[-1, 0]) for c in range(32, 600))
    assert 0.9 < total < 1.05


def test_item_frames(spark, models):
    rows = [("a", None, ID), ("b", "id", ID), ("c", "ID-id", ID), ("d", "en", ID), ("e", "", EN), ("f", "id", f"{ID} {RU}"), ("g", None, None), ("h", None, ""), ("i", "fr", "Dua kata"), ("a", None, ID), (None, None, EN), ("long", "id", (ID + " ") * 3000)]
    df = spark.createDataFrame(rows, "item_id string, label string, text string").withColumn("item_kind", F.lit("chunk")).withColumn("lang", F.lit("clash"))
    got = sorted((str(r.item_id), r.lang) for r in langid.mislabelled(langid.text_languages(df, models)).collect())
    assert got == [("None", "en"), ("a", "id"), ("d", "id"), ("e", "en"), ("f", "id"), ("f", "ru")]
    assert langid.text_languages(df.limit(0), models).count() == 0
    seg = langid.text_segments(df, models).where("item_id = 'f'").orderBy("segment_no").collect()
    assert [(r.lang, r.start) for r in seg] == [("id", 0), ("ru", len(ID))]


SOURCE = ("Visuth paid 12 coins for the rope, and then praised Kranu. The rain did not stop for 46 nights in Port Dilovor. Nobody remembered why the kitchen was full of staffs. "
          "Tiayean looked older than the guard, perhaps because of pride. The healer from Fort Grubo kept 93 anchors before noon.")
GOOD = ("Visuth membayar 12 koin untuk tali itu lalu memuji Kranu. Hujan tidak berhenti selama 46 malam di Port Dilovor. Tidak ada yang ingat mengapa dapur itu penuh dengan tongkat. "
        "Tiayean tampak lebih tua daripada penjaga itu, mungkin karena kebanggaan. Tabib dari Fort Grubo itu menyimpan 93 jangkar sebelum tengah hari.")


def defect(models, answer, source=SOURCE):
    got = pairs.defect_of(source, answer, pairs.languages_of([answer], models.value)[0])
    return got and got[0]


def test_defects(models):
    assert defect(models, GOOD) is None
    assert [defect(models, x) for x in (None, "", " \n", "- -", "…")] == ["empty"] * 5
    assert defect(models, SOURCE) == "copy"
    assert defect(models, "Here is the translation:\n" + SOURCE.lower().replace("rope", "rrope").replace(".", " .")) == "copy"
    assert defect(models, "Maaf, saya tidak dapat menerjemahkan bagian ini. Silakan kirim teks lain.") == "refusal"
    assert defect(models, "[I'M SORRY, BUT I CAN'T TRANSLATE THIS PASSAGE.]") == "refusal"
    assert defect(models, " ".join([RU] * 6)) == "other_language" and defect(models, JA * 8) == "other_language"
    assert defect(models, GOOD[:180]) == "truncated" and defect(models, GOOD[:230] + " [...]") == "truncated"
    assert defect(models, GOOD[:58] + GOOD[170:]) is None  # sentences left out in the middle
    assert defect(models, GOOD + " Catatan penerjemah: istilah ini tidak punya padanan yang tepat.") is None
    talk = '"I am sorry, I cannot help you with the rope," said the guard.'
    assert defect(models, '"Maaf, aku tidak bisa membantumu soal tali itu," kata penjaga tersebut.', talk) is None


def test_refusals_in_other_words_and_of_any_length(models):
    long_en = "I'm sorry, but I cannot translate this passage. " + "It seems to describe events that I would prefer not to discuss, and my guidelines ask me to be careful with such scenes. If you like, I can summarise the chapter in general terms, or suggest another book whose themes are easier to talk about."
    long_id = "Mohon maaf sebesar-besarnya, setelah membaca semuanya dengan teliti saya belum bisa memenuhi permintaan yang Anda kirimkan ini. Ada sejumlah adegan di sini yang menurut pertimbangan saya kurang pantas, sehingga sebaiknya tidak diteruskan. Bila berkenan, saya dapat menceritakan ringkasan umum saja, atau Anda boleh mengirimkan tulisan lain yang lebih ringan supaya dapat kita kerjakan bersama dengan lebih nyaman dan aman. Terima kasih banyak atas pengertiannya hari ini."
    for text in (long_en, long_id, "As an AI, I must refuse.", "Sorry, that is something I am not comfortable rendering.", "Permintaan Anda telah ditolak.", "Teks seperti ini tidak akan saya terjemahkan.", "The request was rejected by the safety filter."):
        assert defect(models, text) == "refusal", text
    assert defect(models, "Tentu saja, berikut ini adalah hasil terjemahan yang sudah saya buat untuk Anda: " + SOURCE) == "copy"
    assert defect(models, GOOD + " Maaf, saya tidak bisa menerjemahkan judul bab ini dengan tepat.") is None
    talk = '"I cannot translate these old letters," the scribe admitted before the fire.'
    assert defect(models, '"Aku tidak bisa menerjemahkan surat-surat tua ini," juru tulis itu mengaku di depan api.', talk) is None
    assert defect(models, "Tabib itu tidak bisa membantu orang sakit itu, lalu ia pulang.", "The healer failed the sick man, and then went home.") is None


def test_lcs_is_the_textbook_one():
    import random
    rng = random.Random(5)
    for _ in range(100):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(12))], [rng.choice("abc") for _ in range(rng.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.common(a, b) == t[-1][-1]
        whole = t[-1][-1]
        assert pairs._reached(a, b) == (next(i for i in range(len(a) + 1) if t[i][-1] == whole), whole)


def test_very_long_answers_end():
    names = " ".join(f"Name{i} Other{i % 50}" for i in range(8000)) + "."
    assert pairs.defect_of(names, names[: len(names) // 2], {})[0] == "copy"
    assert pairs.missing_end(names, names[: len(names) // 2]) > len(names) * 0.4
    assert pairs.refusal_score(names, "tidak menerjemahkan " * 40_000, pairs.words("tidak menerjemahkan " * 40_000)) > 0.9


PROCESSED = "chapter_id string, chunk_id string, translation string, paragraph_translations array<string>, issues array<struct<rule string, message string>>"


def test_defect_frames(spark, models):
    c = spark.createDataFrame([("c", "0", SOURCE), ("c", "0", SOURCE), ("c", "1", "* * *"), ("c", "2", "https://a.b/c"), ("c", "3", SOURCE), ("c", "4", None), (None, "5", SOURCE), ("c", "6", SOURCE)], "chapter_id string, chunk_id string, text string").withColumn("answer", F.lit(1))
    p = spark.createDataFrame([("c", "0", SOURCE, None, [("copy", "x")]), ("c", "0", SOURCE, None, [("copy", "x")]), ("c", "1", "", None, None), ("c", "2", "", None, []), ("c", "4", "", None, None), ("c", "6", None, None, None), ("x", "9", "", None, None)], PROCESSED).withColumn("source", F.lit(1))
    got = sorted((r.chunk_id, r.defect, r.recorded) for r in pairs.defects(c, p, models).collect())
    assert got == [("0", "copy", ["copy"]), ("6", "empty", None)]
    assert pairs.defects(c.limit(0), p, models).count() == 0 and pairs.defects(c, p.limit(0), models).count() == 0


def test_sentence_counting():
    assert align.sentences(['"Do not!" he said. Then?', None, "  ", "One… two. Three", "終。 次"]) == ['"Do not!"', "he said.", "Then?", "One…", "two.", "Three", "終。", "次"]
    assert align.sentences(None) == []


def test_length_alignment_is_optimal():
    got = align.by_length([30, 60, 20, 45], [33, 30, 37, 22, 50])
    assert [(i, j) for i, j, _ in got] == [(0, 0), (2, 3), (3, 4)]
    assert align.by_length([10], [11]) == [(0, 0, 0.0)]


def test_alignment_of_rough_translations(spark, models, tmp_path_factory):
    c = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")
    p = spark.read.parquet("/root/testdata/sf0.01/processed_chunks.parquet")
    src = ["Visuth paid 12 coins for the rope, and then praised Kranu.", "A sharp book lay on the floor of the castle.", "The rain did not stop for 46 nights in Port Dilovor. Kranu laughed and gave the whistle to Visuth.", "* * *"]
    tgt = ["Visuth membayar 12 koin untuk tali itu. Kemudian ia memuji Kranu.", "Catatan penerjemah: istilah ini tidak punya padanan yang tepat.", "Kranu tertawa lalu memberikan peluit itu kepada Visuth. Hujan tidak berhenti selama 46 malam di Port Dilovor.", "* * *"]
    more = spark.createDataFrame([("zz", 0, "z0", [], src, "\n".join(src), 1)] * 2 + [("zz", 1, "z1", [], None, "abc", None), ("zz", 2, "z2", [], ["abc def."], "abc def.", None)], "chapter_id string, chunk_no int, chunk_id string, paragraph_ids array<string>, paragraph_texts array<string>, text string, estimated_tokens int")
    done = spark.createDataFrame([("zz", "z0", "\n".join(tgt), tgt), ("zz", "z1", "abc", ["abc"]), ("zz", "z2", "x y", None)], "chapter_id string, chunk_id string, translation string, paragraph_translations array<string>")
    both = align.aligned(c.unionByName(more), p.unionByName(done, allowMissingColumns=True), models)
    got = sorted((r.src_no, r.tgt_no) for r in both.where("chapter_id = 'zz'").collect())
    assert got == [(0, 0), (0, 1), (2, 4), (3, 3), (4, 5)]
    assert align.aligned(c.limit(0), p, models).count() == 0


def test_alignment_with_a_lexicon_in_blocks(spark, models, monkeypatch):
    c = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet").where("chunk_no < 3")
    p = spark.read.parquet("/root/testdata/sf0.01/processed_chunks.parquet")
    whole = sorted(map(tuple, align.aligned(c, p, models).collect()))
    monkeypatch.setattr(align, "BROADCAST_LIMIT", 16 * 600)
    assert sorted(map(tuple, align.aligned(c, p, models).collect())) == whole and len(whole) > 1000


def test_large_chunks_are_aligned_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    n = 700
    counts = rng.integers(4, 12, n)
    words_ = rng.integers(1, 3000, counts.sum())
    lexicon = (np.sort((np.arange(1, 3000) << 31) | (np.arange(1, 3000) + 10_000)), np.ones(2999))
    tool = align.Aligner(lexicon)
    keep = np.array([i for i in range(n) if i % 50 != 7])  # left-out sentences
    at = np.concatenate([[0], np.cumsum(counts)])
    target = np.concatenate([words_[at[i] : at[i + 1]] + 10_000 for i in keep])
    got = tool.align(words_, counts, target, counts[keep], np.arange(n), -1 - np.arange(len(keep)))
    want = {(int(i), j) for j, i in enumerate(keep)}
    assert len(want & set(got)) >= 0.99 * len(want) and len(set(got) - want) <= 0.01 * len(want)


def test_length_band_grows_with_what_is_left_out():
    s = [50 + 7 * (i % 9) for i in range(40)]
    t = [round(1.1 * x) for x in s[:10] + s[24:]]
    got = {(i, j) for i, j, _ in align.by_length(s, t)}
    want = {(i, i) for i in range(10)} | {(i, i - 14) for i in range(24, 40)}
    assert len(want & got) >= 20  # within the first band none of the last could be


def test_large_chunks_are_aligned_whole(monkeypatch):
    rng = np.random.default_rng(5)
    n = 400  # more than 90,000 pairs
    lengths = rng.integers(4, 12, n)
    source = np.split(rng.integers(1, 3000, lengths.sum()), np.cumsum(lengths)[:-1])
    order = list(range(n))
    order[20], order[380] = 380, 20  # two sentences far apart have changed places
    del order[200]
    target = [source[i] + 10_000 for i in order]
    target[100:101] = np.split(target[100], [len(target[100]) // 2])
    want = {(i, j + (j > 100)) for j, i in enumerate(order)} | {(100, 101)}

    def got(lexicon=(np.sort((np.arange(1, 3000) << 31) | (np.arange(1, 3000) + 10_000)), np.ones(2999))):
        sides = [(np.concatenate(x), np.array([len(w) for w in x])) for x in (source, target)]
        return align.Aligner(lexicon).align(*sides[0], *sides[1], np.arange(n), -1 - np.arange(len(target)))

    whole = got()
    assert {(20, 380), (380, 20), (100, 100), (100, 101)} <= want & set(whole) and len(want & set(whole)) >= 0.99 * len(want)
    for tile, words_, strip in ((10**6, 10**9, 10**9), (37, 200, 9000)):  # one tile, and many
        for name, v in (("TILE", tile), ("TILE_WORDS", words_), ("STRIP", strip)):
            monkeypatch.setattr(align, name, v)
        assert got() == whole


def test_counts_do_not_depend_on_how_rows_are_shared_out(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        a, b = int(rng.integers(3, 50)), int(rng.integers(3, 50))
        rows.append((str(k), rng.choice(40, a, replace=a > 40).tolist(), [a], (100 + rng.choice(60, b)).tolist(), [b]))
    df = spark.createDataFrame(rows, "chunk_id string, left array<int>, left_n array<int>, right array<int>, right_n array<int>")
    counts = [dict(map(tuple, align._expect(df.repartition(parts), None).collect())) for parts in (1, 3, 7)]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) > 1000
