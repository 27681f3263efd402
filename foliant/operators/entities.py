"""Mentions and registered entities: lookup, evidence, research queries and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# Entity types, their category, and the word a search for a type adds.
CHARACTER_TYPES = ("character",)
PROPER_NOUN_TYPES = ("place", "organization", "item", "skill", "race", "title", "proper_noun")
TYPE_WORDS = {"character": "character", "place": "location", "organization": "organization", "item": "item", "skill": "skill", "race": "race", "title": "title"}


def category(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*CHARACTER_TYPES), "characters").when(entity_type.isin(*PROPER_NOUN_TYPES), "proper_nouns")


def normal_type(entity_type: Column) -> Column:
    """A type in lower case; unknown ones are proper_noun."""
    kind = F.lower(T.strip(entity_type))
    return F.when(kind.isin(*CHARACTER_TYPES, *PROPER_NOUN_TYPES), kind).otherwise("proper_noun")


def normal_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions once each, without blank texts; unknown types become proper_noun, confidence lies in [0, 1] and is 0 where missing."""
    c = F.coalesce(F.col("confidence"), F.lit(0.0))
    return mentions.where(T.strip("text") != "").distinct().withColumn("entity_type", normal_type(F.col("entity_type"))).withColumn(
        "confidence", F.when(F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))))


def first_wins(mentions: DataFrame, *more_keys: str) -> DataFrame:
    """The first mention of each name (and further keys), whatever its case and spaces; mention_id gives the order."""
    cols = [c for c in mentions.columns if c not in more_keys]
    rows = mentions.withColumn("name_key", T.normal_name("text"))
    return rows.groupBy("name_key", *more_keys).agg(F.min_by(F.struct(*cols), "mention_id").alias("m")).select("name_key", *more_keys, "m.*")


def name_index(entities: DataFrame) -> DataFrame:
    """(name_key, entity_id): every canonical name and alias; of records that share one the first registered keeps it."""
    names = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("entity_id", F.explode(names).alias("name")).select("entity_id", T.normal_name("name").alias("name_key")).where("name_key <> ''")
    return rows.groupBy("name_key").agg(F.min("entity_id").alias("entity_id"))


def evidence_score(name: Column, title: Column, snippet: Column, url: Column, source: Column, query: Column) -> Column:
    """How well a search result speaks for an entity, in [0, 1], rounded to two places."""
    full = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    key = F.lower(T.strip(name))
    words = F.filter(F.regexp_extract_all(key, F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    every = (F.size(words) > 0) & F.forall(words, lambda w: T.contains_word(full, w))
    score = F.when(T.contains_word(full, key), 0.7).when(every, 0.5).otherwise(0.0)
    score = score + F.when(F.coalesce(url, F.lit("")).rlike(r"^(?i:https?)://[^/?#\s]+"), 0.2).otherwise(0.0)
    score = score + F.when(T.strip(F.coalesce(snippet, F.lit(""))) != "", 0.1).otherwise(0.0)
    score = score + F.when(T.strip(F.coalesce(source, F.lit(""))) != "", 0.05).otherwise(0.0)
    score = score + F.when(F.lower(F.coalesce(query, F.lit(""))).contains(F.lower(name)), 0.05).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 2)


def search_query(name: Column, entity_type: Column, novel: Column | None = None, author: Column | None = None, attempt: int = 1) -> Column:
    """Query of an attempt: the quoted name with its type's word, the novel's title, and from the second attempt on the author."""
    word = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv]), entity_type)
    out = F.concat(F.lit('"'), name, F.lit('"'), F.coalesce(F.concat(F.lit(" "), word), F.lit("")))
    if novel is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit(' "'), novel, F.lit('"')), F.lit("")))
    if author is not None and attempt >= 2:
        out = F.concat(out, F.coalesce(F.concat(F.lit(' "'), author, F.lit('"')), F.lit("")))
    return out


def evidence(entities: DataFrame) -> DataFrame:
    """Research results one a row with score and validity (a score of at least 0.5)."""
    rows = entities.select("entity_id", "canonical_name", "entity_type", F.posexplode("research").alias("n", "r"))
    score = evidence_score(F.col("canonical_name"), F.col("r.title"), F.col("r.snippet"), F.col("r.url"), F.col("r.source"), F.col("r.query"))
    return rows.select("entity_id", "n", "r.url", "r.snippet", "r.confidence", score.alias("score")).withColumn("valid", F.col("score") >= 0.5)


def names_in_order(names: DataFrame, order: str = "ord", name: str = "name") -> DataFrame:
    """(name, ord): stripped names once each, where they first stand; blank ones are left out."""
    return names.select(T.strip(name).alias("name"), F.col(order).alias("ord")).where("name <> ''").groupBy("name").agg(F.min("ord").alias("ord"))


def with_paragraphs(mentions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Mentions with the text of their source paragraph; of paragraphs that share an id the first counts, and a missing one gives a null."""
    first = paragraphs.groupBy(F.col("paragraph_id").alias("source_paragraph_id")).agg(F.min_by("text", F.struct("doc_id", "pos")).alias("paragraph_text"))
    return mentions.join(first, "source_paragraph_id", "left")


def counted(entities: DataFrame) -> DataFrame:
    """(category, n): registered records of each category."""
    return entities.select("entity_id", category(normal_type(F.col("entity_type"))).alias("category")).distinct().groupBy("category").agg(F.count("*").alias("n"))


def resolve_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Each distinct mention with its entity and status: known where a name or alias is registered, research_failed where that record
    says so, else new."""
    found = mentions.withColumn("name_key", T.normal_name("text")).join(name_index(entities), "name_key", "left")
    status = F.when(F.col("entity_id").isNull(), "new").when(F.coalesce("research_failed", F.lit(False)), "research_failed").otherwise("known")
    details = entities.select("entity_id", "canonical_name", "translation", "locked", "research_failed").dropDuplicates(["entity_id"])
    return found.join(details, "entity_id", "left").select("mention_id", "text", "entity_type", "source_paragraph_id", "entity_id", "canonical_name", "translation", "locked", status.alias("status"))


def term_meanings(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, meaning, snippets): a term's registered translation, else up to three snippets of its valid evidence, 300 characters each."""
    keyed = terms.select(F.col("name")).distinct().withColumn("name_key", T.normal_name("name")).join(name_index(entities), "name_key", "left")
    translations = entities.select("entity_id", F.col("translation").alias("meaning")).dropDuplicates(["entity_id"])
    shown = evidence(entities).where("valid and trim(snippet) <> ''").groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("n", F.substring(T.strip(T.collapse("snippet")), 1, 300).alias("s")))).alias("x"))
    shown = shown.select("entity_id", F.transform(F.slice("x", 1, 3), lambda v: v["s"]).alias("snippets"))
    rows = keyed.join(translations, "entity_id", "left").join(shown, "entity_id", "left")
    return rows.select("name", "meaning", F.when(F.col("meaning").isNull(), F.col("snippets")).alias("snippets"))
