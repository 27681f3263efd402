import pytest
from pyspark.sql import functions as F

from foliant.llm import names

ENTITIES = "entity_id bigint, canonical_name string, aliases array<string>"


@pytest.fixture(scope="module")
def entities(spark):
    rows = [
        (1, "Vutrith Yoyiakror", ["V. Yoyiakror"]), (2, "Yoyiakror, Vutrith ", None), (3, "Neabeam Yoyiakror", []), (4, "Brotherhood of the Ivory Helmet", []), (5, "Ivory Helmet Brotherhood", None),
        (6, "Fort Grubo", []), (7, "Lake Grubo", []), (8, "Mamin Steathazea Trudriax", ["Mamy"]), (9, "Mákogi Lugrastal", [None]), (10, None, None), (11, "", [""]), (12, "Yestatholt Trading Company", []), (13, "Capt. Lugrastal", []),
    ]
    return spark.createDataFrame(rows, ENTITIES).withColumn("name", F.lit("clash")).withColumn("entity_type", F.lit(None).cast("string"))


def linked(spark, entities, texts):
    m = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "mention_id bigint, text string").withColumn("entity_id", F.lit(5))
    rows = names.same_entities(entities, m.unionByName(m)).collect()
    assert all(r.id_a < r.id_b for r in rows) and len(rows) == len({(r.id_a, r.id_b) for r in rows})
    per = {i: set() for i in range(len(texts))}
    for r in rows:
        if r.id_b >= 1000:
            per[r.id_b - 1000].add(r.id_a)
    return {(r.id_a, r.id_b) for r in rows if r.id_b < 1000}, [per[i] for i in range(len(texts))]


def test_records_and_typed_names(spark, entities):
    texts = ["Vutrith Yoyiakror", "YOYIAKROR VUTRITH", "vutrithyoyiakror", "Vutka Yoyiakror", "Vutrith \"Vutka\" Yoyiakror", "Vutrtih Yoyiakrr", "Sir Vutrith Yoyiakror", "N. Yoyiakror", "Dr. Yoyiakror",
             "Bhd. of the Ivory Helmet", "Ft. Grubo", "GRUBO LAKE", "Mamin S. Trudriax", "Mamin Trudriax", "Makogi-Lugrastal", "Yestatholt Trdg. Co.", "Kegax Feamork", "Fort Klokopro", None, "", "—", "x" * 5000]
    records, got = linked(spark, entities, texts)
    assert records == {(1, 2), (4, 5), (9, 13)}
    v, lug = {1, 2}, {9, 13}
    assert got == [v, v, v, v, v, v, v, {3}, set(), {4, 5}, {6}, {7}, {8}, {8}, lug, {12}, set(), set(), set(), set(), set(), set()]


def test_empty_tables(spark, entities):
    m = spark.createDataFrame([], "mention_id bigint, text string")
    assert {(r.id_a, r.id_b) for r in names.same_entities(entities, m).collect()} == {(1, 2), (4, 5), (9, 13)}
    assert names.same_entities(entities.limit(0), spark.createDataFrame([(1, "Ann Lee")], m.schema)).count() == 0


def test_near_words_are_all_within_one_edit(spark):
    words = ["grubo", "gruob", "grbo", "grubbo", "gruba", "grxbz", "abc", "abd"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.known, r.edits) for r in names.near_pairs(df, df).collect()}
    assert {(w, k) for w, k, e in got if e == 0} == {(w, w) for w in words}
    assert {k for w, k, e in got if w == "grubo" and e} == {"gruob", "grbo", "grubbo", "gruba"}
    assert not any(k == "abd" for w, k, _ in got if w == "abc")  # too short to be mistyped


def test_nicknames_acronyms_and_rarity(spark):
    rows = [(1, "William Smith", None), (2, "Jill Smith", ["Jill Smythe"]), (3, "Robert Hale", None), (4, "Margaret Osgood", None), (5, "International Business Machines", None), (6, "Elizabeth Crane", None), (7, "Elizabeth Crowe", None),
            (8, "Alpha Trading Company", ["ATC"]), (9, "Amber Trading Company", None), (10, "The Most Worshipful and Ancient Order of Quiet Gardeners Bakers Weavers Fishermen Cobblers Tailors", None)]
    df = spark.createDataFrame(rows, ENTITIES)
    texts = ["Will Smith", "Bob Hale", "Peggy Osgood", "IBM", "I.B.M.", "Liz Crane", "Peggy", "ATC", "ibm", "The Most Worshipful and Ancient Order of Quiet Gradeners Bakres Weavers Fishermne Cobblers Tailros"]
    records, got = linked(spark, df, texts)
    assert records == set()
    assert got == [{1}, {3}, {4}, {5}, {5}, {6}, {4}, {8}, set(), {10}]


def test_a_form_that_many_records_share(spark):
    df = spark.range(400).select(F.col("id").alias("entity_id"), F.lit("Vutrith Yoyiakror").alias("canonical_name"), F.array(F.concat(F.lit("Vutrith Xa"), F.chr((F.col("id") % 20 + 97).cast("long")), F.lit("bodan"))).alias("aliases"))
    m = spark.createDataFrame([(1000, "Yoyiakror, Vutrith")], "mention_id bigint, text string")
    clusters, named = names.entity_clusters(df, m)
    assert clusters.select("cluster").distinct().collect() == [(0,)] and clusters.count() == 400 and [tuple(r) for r in named.collect()] == [(1000, 0)]
