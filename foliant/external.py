"""The boundary to outside services: model calls and searches as replaceable callables, run in Arrow batches.

Nothing here opens a connection. A model is a callable prompt -> text, a search a callable (query, n) -> list of results; they are
made on the executors by a factory, once a worker, so a client with a session is never pickled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

Model = Callable[[str], str]
RESULTS = "served_by string, answer string, error string"


class Unavailable(RuntimeError):
    """A service refused or failed; `daily` says that its quota is spent for the day."""

    def __init__(self, message: str, daily: bool | None = None):
        super().__init__(message)
        low = message.lower().replace(" ", "")
        self.daily = ("perday" in low or ("quota" in low and "daily" in low)) if daily is None else daily


def parse_chain(value: str) -> list[tuple[str, str]]:
    """`provider:model, provider:model` as pairs in order; an entry without a provider has an empty one."""
    out = []
    for part in filter(None, (p.strip() for p in value.split(","))):
        provider, _, model = part.rpartition(":")
        out.append((provider.strip(), model.strip()))
    return out


def chains(value: Column) -> Column:
    """parse_chain as a Column: an array of (provider, model)."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*):[^:]*$", 1)).alias("provider"), F.trim(F.regexp_extract(p, r"([^:]*)$", 1)).alias("model")))


@dataclass
class Failover:
    """Models in order of preference; a model whose daily quota is spent is not asked again."""

    models: list[tuple[str, Model]]
    spent: set[str] = field(default_factory=set)

    def __call__(self, prompt: str) -> tuple[str, str]:
        """(name of the model that served, its answer)."""
        errors = []
        for name, model in self.models:
            if name in self.spent:
                continue
            try:
                return name, model(prompt)
            except (RuntimeError, OSError) as e:
                if getattr(e, "daily", False):
                    self.spent.add(name)
                errors.append(f"{name}: {e}")
        raise Unavailable("; ".join(errors) or "no model left", daily=False)


def ask(prompts: DataFrame, factory: Callable[[], list[tuple[str, Model]]], prompt: str = "prompt") -> DataFrame:
    """Adds served_by, answer and error of each prompt; a failing row does not fail its task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = Failover(factory())
        for b in batches:
            got = []
            for p in b[prompt]:
                try:
                    got.append((*chain(p), None))
                except (RuntimeError, OSError) as e:
                    got.append((None, None, str(e)))
            yield b.assign(**dict(zip(("served_by", "answer", "error"), zip(*got)))) if got else b.assign(served_by=[], answer=[], error=[])

    return prompts.mapInPandas(run, f"{_ddl(prompts)}, {RESULTS}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def answer_json(text: str) -> object:
    """The JSON of an answer, inside a fence or not; ValueError where there is none."""
    return json.loads(re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(), flags=re.I)))


def translate_chunk(model: Model, paragraphs: list[str], translate: Callable[[Model, list[str]], list[str]], depth: int = 3) -> list[str]:
    """One translation a paragraph. Where a model breaks that contract (ValueError) the chunk is halved, at most `depth` times."""
    try:
        out = translate(model, paragraphs)
        if len(out) != len(paragraphs):
            raise ValueError(f"{len(out)} paragraphs for {len(paragraphs)}")
        return out
    except ValueError:
        if depth <= 0 or len(paragraphs) < 2:
            raise
        half = len(paragraphs) // 2
        return [*translate_chunk(model, paragraphs[:half], translate, depth - 1), *translate_chunk(model, paragraphs[half:], translate, depth - 1)]


def retry_passes(chunks: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], check: Callable[[DataFrame], DataFrame], retries: int = 2) -> DataFrame:
    """Chunks with translation, attempts, passed and flagged: each pass runs over the chunks that have not passed yet.

    `attempt` adds `translation` (from the second pass on it sees the last one and its issues), `check` adds `passed`. Passes are cut
    with a checkpoint, so that a lost executor never repeats calls that were paid for.
    """
    from foliant.session import cut

    done, left = None, chunks
    for k in range(1, retries + 2):
        tried = cut(check(attempt(left, k)).withColumn("attempts", F.lit(k)))
        last = k == retries + 1
        ended = tried if last else tried.where("passed")
        ended = ended.withColumn("flagged", ~F.col("passed"))
        done = ended if done is None else done.unionByName(ended, allowMissingColumns=True)
        left = tried.where("not passed").drop("passed", "attempts")
        if not last and left.isEmpty():
            break
    return done


def titles_to_translate(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, title, translated): labels by rule, known titles from the cache; the rest have a null and go to a model."""
    have = cache.select("doc_id", "title", F.col("translated").alias("cached")).dropDuplicates(["doc_id", "title"])
    rows = titles.select("doc_id", "title").distinct().join(have, ["doc_id", "title"], "left")
    return rows.select("doc_id", "title", F.coalesce(T.label_title(F.col("title")), "cached").alias("translated"))
