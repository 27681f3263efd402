"""Operators around model and search calls: which rows are sent, what an answer must keep to, what becomes of failures.

A model is a callable prompt -> text, a search a callable (query, n) -> list of results; both are made on the executors by a factory,
once a worker. Prompts are JSON, so any client can put them into words. A failing row never fails its task: it comes out with an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.external import Model, Unavailable, answer_json, retry_passes, titles_to_translate, translate_chunk
from foliant.functions import markup as M
from foliant.functions import text as T
from foliant.operators import entities as E

#: Answers of a server after which a request is sent again.
AGAIN = (429, 500, 502, 503, 504)


@dataclass
class Retrying:
    """A client of `send` (prompt -> (status, seconds the server asks to wait or None, body)) with retries and growing delays.

    A spent daily quota is not asked for again. `sleep` waits; `waited` and `attempts` tell what the last call took.
    """

    send: Callable[[str], tuple[int, float | None, str]]
    retries: int = 2
    base: float = 2.0
    cap: float = 60.0
    sleep: Callable[[float], None] = lambda seconds: None
    waited: float = field(default=0.0, init=False)
    attempts: int = field(default=0, init=False)

    def __call__(self, prompt: str) -> str:
        self.waited, self.attempts = 0.0, 0
        while True:
            status, after, body = self.send(prompt)
            self.attempts += 1
            if status == 200:
                return body
            failure = Unavailable(f"{status}: {body}")
            if status not in AGAIN or failure.daily or self.attempts > self.retries:
                raise failure
            delay = min(after if after is not None else self.base * 2 ** (self.attempts - 1), self.cap)
            self.waited += delay
            self.sleep(delay)


def _mapped(rows: DataFrame, columns: str, factory: Callable, each: Callable[[object, dict], tuple]) -> DataFrame:
    """Adds `columns` (DDL) that `each(client, row)` gives; one client a worker."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            got = [each(client, r) for r in b.to_dict("records")]
            yield b.assign(**{n: pd.Series([g[k] for g in got], dtype=object, index=b.index) for k, n in enumerate(names)})

    return rows.mapInPandas(run, f"{own}, {columns}")


def ask_with_policy(prompts: DataFrame, factory: Callable[[], Retrying], prompt: str = "prompt") -> DataFrame:
    """Adds answer, error, attempts and waited (seconds)."""

    def each(client: Retrying, row: dict) -> tuple:
        try:
            return client(row[prompt]), None, client.attempts, client.waited
        except (RuntimeError, OSError) as e:
            return None, str(e), client.attempts, client.waited

    return _mapped(prompts, "answer string, error string, attempts int, waited double", factory, each)


def _texts(value) -> list[str]:
    return [] if value is None else ["" if t is None else str(t) for t in value]


def translate_paragraphs(model: Model, paragraphs: list[str], **context) -> list[str]:
    """One translation a paragraph, or ValueError: the answer is a JSON list as long as the paragraphs."""
    got = answer_json(model(json.dumps({"task": "translate", "paragraphs": paragraphs, **context}, ensure_ascii=False)))
    if not isinstance(got, list) or len(got) != len(paragraphs):
        raise ValueError("not one translation a paragraph")
    return [str(x) for x in got]


def refine_paragraphs(model: Model, paragraphs: list[str], before: list[str], issues: list[str], **context) -> list[str]:
    """Translations mended for their issues; an answer of another length leaves them as they were."""
    got = answer_json(model(json.dumps({"task": "refine", "paragraphs": paragraphs, "translations": before, "issues": issues, **context}, ensure_ascii=False)))
    return [str(x) for x in got] if isinstance(got, list) and len(got) == len(before) else before


def translated_chunks(chunks: DataFrame, factory: Callable[[], Model], depth: int = 3) -> DataFrame:
    """Adds paragraph_translations, translation and error to chunks (paragraph_texts); a chunk whose paragraphs are all blank keeps them
    and asks no model, one that breaks the contract is halved, at most `depth` times."""

    def each(model: Model, row: dict) -> tuple:
        texts = _texts(row["paragraph_texts"])
        if not any(t.strip() for t in texts):
            return texts, "\n".join(texts), None
        try:
            got = translate_chunk(model, texts, translate_paragraphs, depth)
            return got, "\n".join(got), None
        except (ValueError, RuntimeError, OSError) as e:
            return None, None, str(e)

    return _mapped(chunks, "paragraph_translations array<string>, translation string, error string", factory, each)


def refined_chunks(chunks: DataFrame, factory: Callable[[], Model], check: Callable[[DataFrame], DataFrame], retries: int = 2) -> DataFrame:
    """Chunks translated, then refined with the issues that `check` found (columns passed, found_issues), in at most retries + 1 attempts.

    A broken answer takes an attempt; what has not passed at the end is flagged.
    """

    def attempt(left: DataFrame, k: int) -> DataFrame:
        def each(model: Model, row: dict) -> tuple:
            texts = _texts(row["paragraph_texts"])
            before = _texts(row.get("paragraph_translations"))
            try:
                if len(before) != len(texts):
                    got = translate_paragraphs(model, texts)
                else:
                    got = refine_paragraphs(model, texts, before, [i["rule"] for i in (row.get("found_issues") if row.get("found_issues") is not None else [])])
                return got, "\n".join(got)
            except (ValueError, RuntimeError, OSError):
                return (before, "\n".join(before)) if before else (None, None)

        had = [c for c in ("paragraph_translations", "translation") if c in left.columns]
        rows = left.withColumnsRenamed({c: f"last_{c}" for c in had})
        tried = _mapped(rows, "paragraph_translations array<string>, translation string", factory, lambda m, r: each(m, {**r, "paragraph_translations": r.get("last_paragraph_translations")}))
        return tried.drop("last_paragraph_translations", "last_translation", "found_issues")

    return retry_passes(chunks, attempt, check, retries)


def cacheable(results: DataFrame, primary: str) -> DataFrame:
    """Results that may go to the cache: passed ones that the primary model itself served."""
    return results.where((F.col("served_by") == primary) & F.coalesce("passed", F.lit(False)))


def put_in_cache(cache: DataFrame, new: DataFrame, version: int = 1) -> DataFrame:
    """A cache (key, cache_version, status, translation) with new entries (key, translation), one a key: a new one takes the place of an
    old one, entries without text are refused."""
    fresh = new.where(T.strip("translation") != "").groupBy("key").agg(F.max("translation").alias("translation")).select("key", F.lit(version).alias("cache_version"), F.lit("passed").alias("status"), "translation")
    return cache.select("key", "cache_version", "status", "translation").join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def drop_from_cache(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def extracted_entities(paragraphs: DataFrame, factory: Callable[[], Model], novel: str | None = None, author: str | None = None) -> DataFrame:
    """(chapter_id, ord, text, entity_type, confidence, source_paragraph_id): candidates that a model names, one call a chapter.

    paragraphs has (chapter_id, pos, paragraph_id, text); a chapter is a row, as the model reads it whole. Candidates without a name or
    with a paragraph that the chapter does not have are dropped; types and confidences become ordinary ones.
    """
    chapters = paragraphs.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph_id", "text"))).alias("p"))

    def each(model: Model, row: dict) -> tuple:
        texts = [x["text"] or "" for x in row["p"]]
        try:
            got = answer_json(model(json.dumps({"task": "entities", "novel": novel, "author": author, "paragraphs": texts}, ensure_ascii=False)))
        except (ValueError, RuntimeError, OSError):
            got = []
        fine = [x for x in got if isinstance(x, dict) and isinstance(x.get("paragraph"), int)] if isinstance(got, list) else []
        return ([{"text": str(x.get("name") or ""), "entity_type": str(x.get("type") or ""), "confidence": str(x.get("confidence")), "at": x["paragraph"]} for x in fine],)

    found = _mapped(chapters, "found array<struct<text:string,entity_type:string,confidence:string,at:int>>", factory, each)
    rows = found.select("chapter_id", "p", F.posexplode("found").alias("ord", "f")).where((F.col("f.at") >= 0) & (F.col("f.at") < F.size("p")) & (T.strip("f.text") != ""))
    return rows.select("chapter_id", "ord", T.strip("f.text").alias("text"), E.normal_type(F.col("f.entity_type")).alias("entity_type"), M.share(F.col("f.confidence")).alias("confidence"), F.get("p", F.col("f.at"))["paragraph_id"].alias("source_paragraph_id"))


def classified_spine(classes: DataFrame, texts: DataFrame, factory: Callable[[], Model]) -> DataFrame:
    """(doc_id, idref, classification, by_model): ambiguous pages go to a model, with their text; answers that name no class change nothing."""
    unsure = classes.where("classification = 'ambiguous'").join(texts.select("doc_id", "idref", "text"), ["doc_id", "idref"], "left")

    def each(model: Model, row: dict) -> tuple:
        try:
            got = answer_json(model(json.dumps({"task": "classify", "text": row["text"]}, ensure_ascii=False)))
            return (str(got.get("classification")) if isinstance(got, dict) else None,)
        except (ValueError, RuntimeError, OSError):
            return (None,)

    asked = _mapped(unsure.select("doc_id", "idref", "text"), "answer string", factory, each).select("doc_id", "idref", M.spine_answer(F.col("answer")).alias("answer"))
    return classes.join(asked, ["doc_id", "idref"], "left").select("doc_id", "idref", F.coalesce("answer", "classification").alias("classification"), F.col("answer").isNotNull().alias("by_model"))


def researched(names: DataFrame, factory: Callable[[], tuple[Callable[[str, int], list[dict]], Callable[[str, str, list[dict]], list[int]]]], novel: str, author: str, attempts: int = 4, asked: int = 20, most: int = 5) -> DataFrame:
    """Adds query, n_queries and results (title, url, snippet, source; at most `most`, in the provider's order) to (name, kind).

    Queries widen from attempt to attempt and none is sent twice in a row; a search that fails finds nothing. A judge (name, query,
    results) chooses the indices of what is evidence; the search ends when it chooses any.
    """
    queries = F.array(*[E.search_query(F.col("name"), F.col("kind"), F.lit(novel), F.lit(author), attempt=k) for k in range(1, attempts + 1)])

    def each(client, row: dict) -> tuple:
        search, judge = client
        last, n = None, 0
        for query in row["queries"]:
            if query == last:
                continue
            last, n = query, n + 1
            try:
                found = search(query, asked)[:asked]
            except (RuntimeError, OSError):
                found = []
            chosen = list(dict.fromkeys(i for i in judge(row["name"], query, found) if 0 <= i < len(found)))[:most] if found else []
            if chosen:
                return query, n, [{k: found[i].get(k) for k in ("title", "url", "snippet", "source")} for i in sorted(chosen)]
        return last, n, []

    rows = _mapped(names.withColumn("queries", queries), "query string, n_queries int, results array<struct<title:string,url:string,snippet:string,source:string>>", factory, each)
    return rows.drop("queries")


def entity_pipeline(mentions: DataFrame, entities: DataFrame, factory: Callable, novel: str, author: str) -> DataFrame:
    """(mention_id, text, entity_id, status, n_valid): first mentions of each name, those of known records reused, new ones researched.

    A new name with valid evidence is `created`, one whose evidence is all refused is `research_failed`.
    """
    firsts = E.resolve_mentions(E.first_wins(E.normal_mentions(mentions)), entities)
    new = firsts.where("status = 'new'").select("mention_id", F.col("text").alias("name"), F.col("entity_type").alias("kind"))
    found = researched(new, factory, novel, author).select("mention_id", "name", "query", F.explode_outer("results").alias("r"))
    score = E.evidence_score(F.col("name"), F.col("r.title"), F.col("r.snippet"), F.col("r.url"), F.col("r.source"), F.col("query"))
    valid = found.groupBy("mention_id").agg(F.count_if(F.col("r").isNotNull() & (score >= 0.5)).alias("n_valid"))
    rows = firsts.join(valid, "mention_id", "left")
    status = F.when(F.col("status") != "new", F.col("status")).when(F.col("n_valid") > 0, "created").otherwise("research_failed")
    return rows.select("mention_id", "text", "entity_id", status.alias("status"), F.coalesce("n_valid", F.lit(0)).cast("int").alias("n_valid"))


def translated_titles(titles: DataFrame, cache: DataFrame, factory: Callable[[], Model]) -> DataFrame:
    """(doc_id, title, translated, origin): labels by rule, known titles from the cache, the rest from a model; an answer that breaks the
    rules of titles is refused and the title stays as it is."""
    rows = titles_to_translate(titles, cache)
    label = T.label_title(F.col("title"))
    known = rows.where(F.col("translated").isNotNull()).select("doc_id", "title", "translated", F.when(label.isNotNull(), "label").otherwise("cache").alias("origin"))

    def each(model: Model, row: dict) -> tuple:
        try:
            return (str(answer_json(model(json.dumps({"task": "title", "title": row["title"]}, ensure_ascii=False)))),)
        except (ValueError, RuntimeError, OSError):
            return (None,)

    asked = _mapped(rows.where(F.col("translated").isNull()).select("doc_id", "title"), "answer string", factory, each)
    fine = F.col("answer").isNotNull() & (T.strip("answer") != "") & T.title_error(F.col("title"), F.col("answer")).isNull()
    return known.unionByName(asked.select("doc_id", "title", F.when(fine, F.col("answer")).otherwise(F.col("title")).alias("translated"), F.when(fine, "model").otherwise("refused").alias("origin")))


def translated_terms(terms: DataFrame, entities: DataFrame, factory: Callable[[], Model]) -> DataFrame:
    """(name, meaning, origin): registered translations first, then a model with up to three snippets of evidence; a failure leaves a null."""
    rows = E.term_meanings(terms, entities)

    def each(model: Model, row: dict) -> tuple:
        try:
            return (str(answer_json(model(json.dumps({"task": "term", "name": row["name"], "evidence": _texts(row["snippets"])}, ensure_ascii=False)))),)
        except (ValueError, RuntimeError, OSError):
            return (None,)

    asked = _mapped(rows.where("meaning is null").select("name", "snippets"), "answer string", factory, each)
    known = rows.where("meaning is not null").select("name", "meaning", F.lit("entities").alias("origin"))
    return known.unionByName(asked.select("name", F.col("answer").alias("meaning"), F.when(F.col("answer").isNull(), "none").otherwise("model").alias("origin")))


def needs_model(paragraph_texts: Column) -> Column:
    """Whether any paragraph of a chunk has text."""
    return F.exists(F.coalesce(paragraph_texts, F.array().cast("array<string>")), lambda t: F.coalesce(T.strip(t) != "", F.lit(False)))
