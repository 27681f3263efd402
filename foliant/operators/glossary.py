"""Glossaries: aliases, pruning of name variants, containment, merging and replacement in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import BROADCAST_LIMIT


def resolve_aliases(glossary: DataFrame) -> DataFrame:
    """(term, meaning, line_no) of active terms; an alias takes the meaning of the term its right side names, in any case.

    Of terms repeated under that name the last line's meaning counts; aliases without such a term are dropped.
    """
    rows = glossary.where(F.coalesce("active", F.lit(True)) & (T.strip("term") != "") & (T.strip("meaning") != "")).select(
        "line_no", T.strip("term").alias("term"), T.strip("meaning").alias("meaning"), F.coalesce("is_alias", F.lit(False)).alias("is_alias"))
    terms = rows.where(~F.col("is_alias"))
    table = terms.groupBy(F.lower("term").alias("k")).agg(F.max_by("meaning", "line_no").alias("m"))
    aliases = rows.where("is_alias").join(table, F.lower("meaning") == F.col("k")).select("term", F.col("m").alias("meaning"), "line_no")
    return terms.select("term", "meaning", "line_no").unionByName(aliases)


def prune_variants(names: DataFrame) -> DataFrame:
    """(core, name, kind, ord): one row for each core of (ord, name, kind), the plainest variant, the earliest of equals."""
    core, words = T.core_words(T.strip("name")), T.name_words(T.strip("name"))
    rows = names.select("ord", T.strip("name").alias("name"), "kind", F.array_join(core, " ").alias("core"), F.size(core).alias("n_core"), F.size(words).alias("n"))
    rank = F.struct((F.col("n") - F.col("n_core")).alias("a"), F.col("n").alias("b"), F.length("name").alias("c"), "ord", "name")
    return rows.where("core <> ''").groupBy("core").agg(
        F.min_by(F.struct("name", "kind"), rank).alias("best"), F.min("ord").alias("ord")).select("core", T.display_name("best.name").alias("name"), "best.kind", "ord")


def not_contained(names: DataFrame) -> DataFrame:
    """Distinct names (core) whose words do not stand together inside a longer one's: an equi-join on the words of the shorter.

    Each longer name gives its proper sub-lists of words, so no pair of names is compared that does not match.
    """
    words = names.select("core").distinct().withColumn("w", F.split("core", " "))
    inner = words.where(F.size("w") > 1).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))).alias("core")).distinct()
    return words.select("core").join(inner, "core", "left_anti")


def new_terms(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Found terms (name, kind) that no line of a glossary, active or not, has under the same name in any case."""
    have = existing.select(F.lower(T.strip("term")).alias("k")).distinct()
    return found.join(have, F.lower(T.strip("name")) == F.col("k"), "left_anti")


def grouped_by_kind(found: DataFrame) -> DataFrame:
    """(kind, names): names of each kind in order of their lower case; unknown kinds stand under `lainnya`."""
    rows = found.select(F.coalesce("kind", F.lit("lainnya")).alias("kind"), "name").distinct()
    return rows.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))).alias("x")).select("kind", F.transform("x", lambda s: s["name"]).alias("names"))


def merged_lines(existing: DataFrame, found: DataFrame, default_section: str = "lainnya") -> DataFrame:
    """(section, line_no, term, meaning): a glossary with the new terms behind the lines of their section, in order of their names."""
    new = new_terms(found, existing).select(F.coalesce("kind", F.lit(default_section)).alias("section"), "name", "meaning").dropDuplicates(["section", "name"])
    w = Window.partitionBy("section").orderBy(F.lower("name"), "name")
    ends = existing.groupBy("section").agg(F.max("line_no").alias("last"))
    placed = new.join(ends, "section", "left").select("section", (F.coalesce("last", F.lit(0)) + F.row_number().over(w) / 100000.0).cast("double").alias("line_no"), F.col("name").alias("term"), "meaning")
    return existing.select("section", F.col("line_no").cast("double").alias("line_no"), "term", "meaning").unionByName(placed)


class Replacer:
    """Terms and their replacements as an automaton over characters, so a text is read once however many terms there are."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.terms = [(left, right) for left, right in pairs if left]
        forms: dict[str, tuple[int, str]] = {}
        for k, (left, right) in enumerate(self.terms):
            for form in (left, left.replace("’", "'"), left.replace("'", "’")):
                forms.setdefault(form, (k, right))
        self.next: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for form, (_, right) in forms.items():
            at = 0
            for c in form:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.out.append(None)
                at = self.next[at][c]
            self.out[at] = right
        firsts = "".join(sorted({re.escape(f[0]) for f in forms}))
        self.start = re.compile(f"(?<![A-Za-z])[{firsts}]") if forms else None

    def __call__(self, text: str) -> str:
        if self.start is None:
            return text
        parts, at = [], 0
        while m := self.start.search(text, at):
            i, state, best = m.start(), 0, None
            while i < len(text) and (state := self.next[state].get(text[i])) is not None:
                i += 1
                if self.out[state] is not None and not (i < len(text) and text[i].isascii() and text[i].isalpha()):
                    best = (i, self.out[state])
            if best is None:
                parts.append(text[at : m.start() + 1])
                at = m.start() + 1
            else:
                parts += [text[at : m.start()], best[1]]
                at = best[0]
        return "".join([*parts, text[at:]])


_replacers: list[tuple[object, Replacer]] = []


def replace_terms(texts: DataFrame, text_col: str, glossary: DataFrame, out: str = "replaced", limit: int = BROADCAST_LIMIT // 16) -> DataFrame:
    """Adds a text with its terms replaced: case-sensitive, longest first, in one pass, between characters that are no ASCII letters,
    with either apostrophe; of repeated terms the first counts.

    The terms go to every executor if their text is at most `limit` bytes (the automaton takes several times that). Beyond it, each
    text gets the terms that may stand in it by an equi-join on terms' first words, and they are replaced in the same way.
    """
    terms = glossary.where("length(term) > 0").groupBy("term").agg(F.min_by("meaning", "line_no").alias("meaning"), F.min("line_no").alias("line_no"))
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length("meaning"))).first()[0] or 0
    if size <= limit:
        rows = terms.orderBy("line_no").toPandas()
        shared = texts.sparkSession.sparkContext.broadcast(list(zip(rows["term"], rows["meaning"])))

        @F.pandas_udf("string")
        def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if not _replacers or _replacers[0][0] is not shared.value:
                _replacers[:] = [(shared.value, Replacer(shared.value))]
            for s in batches:
                yield s.map(_replacers[0][1], na_action="ignore")

        return texts.withColumn(out, replaced(F.col(text_col)))

    plain = lambda c: F.replace(c, F.lit("’"), F.lit("'"))
    word = r"[A-Za-z]+|[^A-Za-z\s]"
    first = terms.withColumn("w", F.regexp_extract(plain(F.col("term")), word, 0))
    distinct = texts.select(F.col(text_col).alias("__t")).where("__t is not null").distinct().withColumn("__h", F.md5("__t"))
    asked = distinct.select("__h", F.explode(F.array_distinct(F.regexp_extract_all(plain(F.col("__t")), F.lit(word), F.lit(0)))).alias("w"))
    found = asked.join(first, "w").groupBy("__h").agg(F.array_sort(F.collect_list(F.struct("line_no", "term", "meaning"))).alias("terms"))

    @F.pandas_udf("string")
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, terms_ in batches:
            yield pd.Series([Replacer([(x["term"], x["meaning"]) for x in y])(v) if y is not None else v for v, y in zip(t, terms_)], dtype=object)

    made = distinct.join(found, "__h", "left").select("__t", each(F.col("__t"), F.col("terms")).alias(out))
    return texts.join(made, F.col(text_col) == F.col("__t"), "left").drop("__t")
