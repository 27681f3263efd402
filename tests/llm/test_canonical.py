from pyspark.sql import functions as F

from foliant.llm import canonical as C

CASES = {
    "\uff26\uff55\uff4c\uff4c \uff11\uff12": "Full 12", "\ufb01ne sta\ufb00": "fine staff", "Gaso\u0301ka": "Gas\u00f3ka", "f\u200bo\u00adr": "for", "a\u00a0b\u2007c\u3000d": "a b c d",
    "th\u0435 \u0430nd \u0391": "the and A", "\u0251\u0261e": "age", "cast\u04cfe": "castle", "\u041cr\u043egal": "Mrogal", "\uff28\uff45\u200d\uff4c\uff4c\u043e": "Hello", "\ufeffword": "word",
}
PLAIN = [
    "\u0421\u043c\u043e\u0442\u0440\u0438!", "\u041a\u043e\u043b\u044c\u0446\u043e \u0441\u0442\u0440\u0430\u0436\u0438", "\u03a3\u03bf\u03c6\u03af\u03b1 waited", "\u300c\u5263\u300d\u306f\u91cd\u3044\u3002",
    "\u201ccurly\u201d \u2018x\u2019 \u2014 \u2026", "\u00c6rendil \u00d1andor Tr\u00e8s \u00dcber", "plain", "", "\U0001f469\u200d\U0001f680 ok", "tab\there\nnew\r\n", "\u0646\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "x\u0302 stays", "\u0663\u0664",
]


def frame(spark):
    rows = [("run", str(i), 0, t) for i, t in enumerate([*CASES, *PLAIN])] + [("run", "n", 0, None), ("run", "0", 0, next(iter(CASES))), (None, None, None, "a b")]
    return spark.createDataFrame(rows, "item_kind string, item_id string, run_no int, text string").withColumn("word", F.lit("clash")).withColumn("canonical", F.lit(1))


def test_forms(spark):
    got = {r.text: r.canonical for r in C.canonical_texts(frame(spark), "text", "item_kind", "item_id", "run_no").collect()}
    assert {t: got[t] for t in CASES} == CASES
    assert all(got[t] == t for t in PLAIN) and got[None] is None


def test_found_are_the_changed_ones_once(spark):
    got = sorted(str(r.item_id) for r in C.changed_ids(frame(spark), "text", "item_kind", "item_id", "run_no").collect())
    assert got == sorted([str(i) for i in range(len(CASES))] + ["None"])


def test_equal_terms_compare_equal(spark):
    df = spark.createDataFrame([("Gasóka",), ("Gasóka",), ("Gаsóka",), ("Gas​óka",), ("Gasoka",)], "text string")
    got = [r.canonical for r in C.canonical_texts(df, "text").collect()]
    assert sorted(got) == ["Gasoka", "Gasóka", "Gasóka", "Gasóka", "Gasóka"]


def test_empty_long_and_null_runs(spark):
    empty = spark.createDataFrame([], "k string, text string")
    assert C.changed_ids(empty, "text", "k").count() == 0 and C.canonical_texts(empty, "text", "k").count() == 0
    long = spark.createDataFrame([("a", "wоrd " * 100_000), ("b", "w" * 500_000 + " ")], "k string, text string")
    got = {r.k: r.canonical for r in C.canonical_texts(long, "text", "k").collect()}
    assert got["a"] == "word " * 100_000 and got["b"] == "w" * 500_000 + " "
    runs = spark.createDataFrame([("p", None), ("q", []), ("r", [(None,), ("x y",)])], "paragraph_id string, runs array<struct<text string>>")
    assert [(r.item_id, r.run_no) for r in C.changed_ids(C.run_texts(runs), "text", "item_id", "run_no").collect()] == [("r", 1)]


OWN = [
    "У нас есть хор и оса", "А он сказал: с тобой", "Он видел её. А потом, у реки, она села.", "Ο άνθρωπος και ο σκύλος είναι ο φίλος μου", "Те са тук, а аз съм с тях.", "Сова и рак", "— А ты? — спросил он (Bob).",
    "а", "Նա ո՞ւր է",
]
MIXED = {
    "He met “Иван” а friend": "He met “Иван” a friend", "the оса flew": "the oca flew", "а man, Иван, sat": "a man, Иван, sat", "𝐇𝐞𝐥𝐥𝐨 ℓ Ⅳ ʜaze": "Hello l IV haze",
    "Он сказал: they hаve о": "Он сказал: they have o", "Нaпример": "Нaпример",
}


def test_words_in_their_own_script_stay(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*OWN[:-2], OWN[-1], *MIXED])], "i int, text string")
    got = {r.text: r.canonical for r in C.canonical_texts(df, "text", "i").collect()}
    assert {t: got[t] for t in MIXED} == MIXED
    assert [t for t in got if t not in MIXED and got[t] != t] == []
    changed = {r.i for r in C.changed_ids(df, "text", "i").collect()}
    assert changed == {i for i, t in enumerate([*OWN[:-2], OWN[-1], *MIXED]) if got[t] != t}
