"""Records that name the same person, organisation or place, by canonical rewritings.

A name is taken apart into folded words (no case, accents, titles, articles; one spelling for c/k, y/i and ks/x; abbreviated legal
forms and place kinds written out). Words that people mistype are rewritten to registered words one edit away, found by an
equi-join on the words' one-letter deletions. Each name is then rewritten in every way the rules allow: token order (sorted pairs
and sets), left-out middle names, nicknames (a table of given names, and the first three letters with a pet ending), initials, title
and surname, words run together, kind words moved and acronyms. The rewritings are exploded and equi-joined. A rewriting's score is
what it leaves out (its cost) and how common it is (RARITY times the logarithm of the entities that have it), and a candidate counts
only if, at a name's best score, all its matches are records of one entity.

Records are joined in two rounds, so that the second can tell how many entities share a rewriting: rewritings that keep given name
and surname (or all words of an organisation or place) first, then, for records that have no such name, those that keep less. No
form is joined record by record: in the first round the records of a form hang together by the least of them, in the second and for
mentions a form brings two or three entities at most, as more of them could only tie. So a form that a third of all records share
costs as much as any other.

Defined results: null, empty and letterless names match nothing; repeated rows count once; null entity types are ignored, as
entity types are wrong too often to tell entities apart; names of entities that no registered record carries match nothing.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut

# Titles, articles, kind words with their abbreviations, pet endings.
TITLES = {"dr", "sir", "lord", "lady", "master", "capt", "captain", "mr", "mrs", "ms", "miss", "prof", "king", "queen", "prince", "princess", "father", "brother", "sister"}
ARTICLES = {"the", "of", "and", "a"}
KINDS_FIRST = {"order", "brotherhood", "fort", "lake", "mount", "port", "house", "kingdom", "temple"}
KINDS_LAST = {"guild", "academy", "company", "valley", "clan", "sect", "school"}
ABBREVIATED = {
    "acad": "academy", "bhd": "brotherhood", "co": "company", "ft": "fort", "gld": "guild", "lk": "lake", "mt": "mount",
    "ord": "order", "pt": "port", "trdg": "trading", "vly": "valley",
}
#: Given names and what their bearers are called.
CALLED = {
    "abigail": "abby gail", "albert": "al bert bertie", "alexander": "alex sandy xander", "alfred": "alf alfie fred", "andrew": "andy drew", "anthony": "tony", "arthur": "art artie", "barbara": "babs barb barbie",
    "benjamin": "ben benny", "catherine": "cathy kate katie kitty", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothy": "dot dottie dolly",
    "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora", "elizabeth": "bess beth betsy betty eliza libby lisa liz lizzie", "emily": "em emmy", "frances": "fanny fran", "francis": "frank", "frederick": "fred freddie",
    "gerald": "gerry jerry", "gregory": "greg", "harold": "hal harry", "helen": "nell nellie", "henry": "hal hank harry", "isabella": "bella izzy", "jacob": "jake", "james": "jamie jim jimmy", "jennifer": "jen jenny",
    "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "judith": "judy", "katherine": "kate kathy katie kit kitty", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny", "margaret": "daisy greta maggie marge meg peggy",
    "martha": "marty patty", "mary": "molly polly", "matthew": "matt", "michael": "mick mickey mike", "nathaniel": "nat nate", "nicholas": "nick nicky", "patricia": "pat patsy tricia trish", "patrick": "paddy pat", "peter": "pete",
    "philip": "phil pip", "rebecca": "becca becky", "richard": "dick rich rick ricky", "robert": "bob bobby rob robbie", "ronald": "ron ronnie", "samuel": "sam sammy", "sarah": "sadie sally", "stephen": "steve", "susan": "sue susie",
    "theodore": "ted teddy theo", "theresa": "terry tess tessa", "thomas": "tom tommy", "timothy": "tim", "victoria": "tori vicky", "walter": "wally walt", "william": "bill billy liam will willie",
}
PET_ENDINGS = ("y", "ie", "ka", "in", "o")

#: Costs of the rewritings, beside one a mistyped word, and what a form costs by the logarithm of the entities that have it; a name's
#: matches must agree at its lowest cost.
COST = {"full": 0.0, "joined": 0.3, "called": 0.8, "nick": 1.4, "initial": 2.4, "title": 3.0, "acronym": 3.4, "pet": 3.6}
#: Rewritings of the first round.
STRONG = ("full", "joined", "called", "nick")
RARITY = 0.3
#: Words of a name that are rewritten in every combination; if more are mistyped, all at once or, in names of more than LONG words, one at a time.
MISTYPED, LONG = 3, 12
#: Letters of the shortest word that may be mistyped, and of the shortest name run together.
TYPO_LENGTH, JOINED_LENGTH = 4, 9


def fold(word: str) -> str:
    """One spelling for the ways a word is typed."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return w.replace("ks", "x").replace("c", "k").replace("y", "i")


_FOLDED = {fold(k): fold(v) for k, v in ABBREVIATED.items()}
_FIRST, _LAST = {fold(k) for k in KINDS_FIRST}, {fold(k) for k in KINDS_LAST | {"trading"}}
_PET = tuple(sorted({fold(e) for e in PET_ENDINGS}, key=len, reverse=True))
_FORMAL: dict[str, list[str]] = {}
for _formal, _called in CALLED.items():
    for _c in _called.split():
        _FORMAL.setdefault(fold(_c), []).append(fold(_formal))
_TITLES = {fold(t) for t in TITLES}
_ARTICLES = {fold(t) for t in ARTICLES}
_QUOTED = re.compile(r"[\"“”«»„][^\"“”«»„]*[\"“”«»„]")
_WORD = re.compile(r"[^\W_]+")


def parse(name: str | None) -> dict | None:
    """Words of a name in order (surname last where a comma says so), whether a title stood before, and whether it is a group or place."""
    if not name:
        return None
    text = _QUOTED.sub(" ", name)
    text = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", text)
    head, _, tail = text.partition(",")
    raw = [fold(w) for w in _WORD.findall(f"{tail} {head}" if tail.strip() else text)]
    words = [_FOLDED.get(w, w) for w in raw if w not in _TITLES and w not in _ARTICLES]
    if not words:
        return None
    kind = any(w in _FIRST or w in _LAST for w in words)
    return {"words": words, "title": any(w in _TITLES for w in raw), "kind": kind, "bare": len(raw) == 1, "caps": name.strip().isupper()}


def _pet_stem(word: str) -> str | None:
    for e in _PET:
        if word.endswith(e) and len(word) - len(e) == 3:
            return word[:3]
    return None


def rewritings(name: str, near: dict[str, list[tuple[str, int]]], registered: bool) -> list[tuple[str, str, float, str]]:
    """(form, kind, cost, middle) of a name. `near` has the registered words close to a word, with their edits.

    Registered names give the forms that others may have cut down to; both sides give the forms of what they are.
    """
    p = parse(name)
    if p is None:
        return []
    words = p["words"]
    out: dict[tuple[str, str, str], float] = {}

    def put(form: str, kind: str, cost: float, middle: str = "") -> None:
        key = (form, kind, middle)
        out[key] = min(out.get(key, 99.0), COST[kind] + cost)

    def choices(ws: list[str]) -> Iterator[tuple[tuple[str, ...], int]]:
        """Every way to rewrite at most MISTYPED words of a name to registered ones; the other words stay as typed."""
        other = [[v for v, e in near.get(w, ()) if e] for w in ws]
        spots = [i for i, o in enumerate(other) if o]
        if len(spots) > (MISTYPED if len(ws) <= LONG else 1):
            yield tuple(o[0] if o else w for w, o in zip(ws, other)), len(spots)
        for k in range(min(MISTYPED if len(ws) <= LONG else 1, len(spots)) + 1):
            for at in itertools.combinations(spots, k):
                for pick in itertools.product(*(other[i] for i in at)):
                    out_ = list(ws)
                    for i, v in zip(at, pick):
                        out_[i] = v
                    yield tuple(out_), k

    if p["kind"] or any(v in _FIRST or v in _LAST for w in words for v, _ in near.get(w, ()) if len(w) > 3):
        for ws, e in choices(words):
            if not any(w in _FIRST or w in _LAST for w in ws):
                continue
            put("k:" + " ".join(sorted(ws)), "full", e)
            put("j:" + "".join(sorted(ws)), "joined", e)
            if registered and len(ws) > 1:
                ordered = [w for w in ws if w in _FIRST] + [w for w in ws if w not in _FIRST and w not in _LAST] + sorted((w for w in ws if w in _LAST), reverse=True)
                put("a:" + "".join(w[0] for w in ordered), "acronym", e)
    full = [w for w in words if len(w) > 1]
    initials = [w for w in words if len(w) == 1]
    if not p["kind"] and len(full) >= 2:
        given, middle, last = full[0], full[1:-1], full[-1]
        pairs = [((given, last), middle)]
        if len(full) == 3:
            pairs += [((full[0], full[1]), [full[2]]), ((full[1], full[2]), [full[0]])] if not registered else []
        for (a, b), rest in pairs:
            mid = "".join(w[0] for w in [*rest, *initials])[:1]
            for (x, y), e in choices([a, b]):
                put("p:" + " ".join(sorted((x, y))), "full", e, mid)
                if (a, b) == (given, last):
                    for w, other in ((x, y), (y, x)):
                        if registered:
                            put(f"n:{w[:3]} {other}", "nick", e)
                            put(f"i:{w[0]} {other}", "initial", e)
                            put("j:" + w + other, "joined", e)
                            put("s:" + w, "title", e)
            for w, other in ((a, b), (b, a)):
                for formal in _FORMAL.get(w, ()):
                    for (o,), e in choices([other]):
                        put("p:" + " ".join(sorted((formal, o))), "called", e, mid)
                if stem := _pet_stem(w):
                    for (o,), e in choices([other]):
                        put(f"n:{stem} {o}", "nick", e)
        if registered:
            for x in (given, last):
                put("m:" + x[:3], "pet", 0)
            for x in {given, *_FORMAL.get(given, ())}:
                put("g:" + x, "pet", 0)
            if len(full) > 2:
                put("A:" + "".join(x[0] for x in full), "acronym", 0)
    if not p["kind"] and len(full) == 1 and initials:
        for (w,), e in choices(full):
            for i in {initials[0], initials[-1]}:
                put(f"i:{i} {w}", "initial", e)
    if not p["kind"] and len(full) == 1 and not initials:
        w = full[0]
        if p["title"]:
            for (x,), e in choices([w]):
                put("s:" + x, "title", e)
        if len(w) >= JOINED_LENGTH and not p["title"]:
            put("j:" + w, "joined", 0)
            for cut_ in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
                put("d:" + cut_, "joined", 1)
        if stem := _pet_stem(w):
            put("m:" + stem, "pet", 0)
        if p["bare"] and 2 <= len(w) <= 4:
            put("a:" + w, "acronym", 0)
        if p["bare"] and p["caps"] and 3 <= len(w) <= 6:
            put("A:" + w, "acronym", 0)
        for formal in _FORMAL.get(w, ()):
            put("g:" + formal, "pet", 0)
    if not p["kind"] and not full and len(initials) > 2 and p["caps"]:
        put("A:" + "".join(initials), "acronym", 0)
    if registered and not p["kind"] and len(full) >= 2:
        for j in (full[0] + full[-1], full[-1] + full[0]):
            put("d:" + j, "joined", 1)
            for i in range(len(j)):
                put("d:" + j[:i] + j[i + 1 :], "joined", 1)
    return [(form, kind, cost, middle) for (form, kind, middle), cost in out.items()]


def _parsed(names: DataFrame) -> DataFrame:
    """(name, own, words): distinct names with their folded words; names without any are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, own, p["words"]) for n, own in zip(b["name"], b["own"]) if (p := parse(n))]
            yield pd.DataFrame(rows, columns=["name", "own", "words"])

    return names.select("name", "own").mapInPandas(run, "name string, own boolean, words array<string>")


def _deletions(word: Column) -> Column:
    n = F.length(word)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n >= TYPO_LENGTH, each).otherwise(F.array(word))))


def near_pairs(words: DataFrame, registered: DataFrame) -> DataFrame:
    """(word, known, edits): the registered words that are a word or one edit (or one moved letter) from it."""
    a = words.select("word").distinct().select("word", F.explode(_deletions(F.col("word"))).alias("cut"))
    b = registered.select(F.col("word").alias("known")).distinct().select("known", F.explode(_deletions(F.col("known"))).alias("cut"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    moved = (F.length("word") == F.length("known")) & (letters(F.col("word")) == letters(F.col("known")))
    pairs = a.join(b, "cut").where((F.col("word") == F.col("known")) | (F.least(F.length("word"), F.length("known")) >= TYPO_LENGTH))
    pairs = pairs.select("word", "known").distinct().where((F.levenshtein("word", "known") <= 1) | moved)
    return pairs.select("word", "known", F.when(F.col("word") == F.col("known"), 0).otherwise(1).alias("edits"))


def _forms(parsed: DataFrame, near: DataFrame) -> DataFrame:
    """(name, own, registered, form, kind, cost, middle) of distinct names: what they may be cut down to if registered, and what they are."""
    # a word has no letters outside its alphabet, so flat strings carry the pairs
    flat = F.concat_ws(" ", "word", "known", F.col("edits").cast("string"))
    per = parsed.select("name", F.explode(F.array_distinct("words")).alias("word")).join(near, "word").groupBy("name").agg(F.collect_list(flat).alias("near"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, own, near_ in zip(b["name"], b["own"], b["near"]):
                options: dict[str, list[tuple[str, int]]] = {}
                for x in near_ if near_ is not None else ():
                    word, known, edits = x.split(" ")
                    options.setdefault(word, []).append((known, int(edits)))
                for v in options.values():
                    v.sort(key=lambda x: (x[1], x[0]))
                for side in (True, False) if own else (False,):
                    rows += [(name, own, side, *f) for f in rewritings(name, options, side)]
            yield pd.DataFrame(rows, columns=["name", "own", "registered", "form", "kind", "cost", "middle"])

    joined = parsed.select("name", "own").join(per, "name", "left")
    return joined.mapInPandas(run, "name string, own boolean, registered boolean, form string, kind string, cost double, middle string")


def _components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity_id, cluster): the least id reachable over pairs (a, b); a few rounds of joins, with lineage cut after each."""
    both = cut(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b").distinct())
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    label = nodes.join(least, nodes.entity_id == least.a, "left").select("entity_id", F.least("entity_id", F.coalesce("least", "entity_id")).alias("cluster"))
    while True:
        reach = both.join(label, both.b == label.entity_id).groupBy("a").agg(F.min("cluster").alias("least"))
        new = cut(label.join(reach, label.entity_id == reach.a, "left").select("entity_id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("least", "cluster")).alias("cluster")))
        label = new.select("entity_id", "cluster")
        if new.where("cluster < old").isEmpty():
            return label


def _middles_agree() -> Column:
    a, b = F.col("middle"), F.col("o_middle")
    return (a == "") | (b == "") | (F.left(a, F.lit(1)) == F.left(b, F.lit(1)))


def _decided(matches: DataFrame, key: str) -> DataFrame:
    """(key, cluster) where all matches (key, round, cost, cluster) of the key's first round at its lowest cost are records of one entity.

    A key has as many matches as its forms bring, a few each.
    """
    m = matches.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("round", "cost", "cluster"))).alias("m"))
    first = F.col("m")[0]
    near = F.filter("m", lambda x: (x["round"] == first["round"]) & (x["cost"] <= first["cost"] + 0.05))
    return m.select(key, F.array_distinct(F.transform(near, lambda x: x["cluster"])).alias("c")).where("size(c) = 1").select(key, F.col("c")[0].alias("cluster"))


def _matches(asked: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(name, round, cost, cluster) of the names that share a form with an entity (form, middle, cluster, o_cost).

    A rewriting costs what it leaves out and how common its form is. Whoever asks for a form wants to know whether one entity has it,
    so of the entities with one cost and middle name two (three, if the asker's own is to be left out) tell as much as all: more could
    only tie with those. So no form grows with the records that share it.
    """
    count = held.groupBy("form").agg(F.count_distinct("cluster").alias("n"))
    w = Window.partitionBy("form", "o_cost", "middle").orderBy("cluster")
    few = held.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    few = few.join(count, "form").select("form", "o_cost", F.col("middle").alias("o_middle"), "cluster", (F.log("n") * RARITY).alias("rarity"))
    return asked.join(few, "form").where(_middles_agree()).select("name", F.when(F.col("kind").isin(*STRONG), 1).otherwise(2).alias("round"), (F.col("cost") + F.col("o_cost") / 2 + F.col("rarity")).alias("cost"), "cluster")


def entity_clusters(entities: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entity_id, cluster) of all records, (mention_id, cluster) of the mentions that name one): the least id of an entity's records."""
    records = entities.select(F.col("entity_id").cast("bigint").alias("entity_id"), F.explode(F.array_union(
        F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null").distinct()
    typed = mentions.select(F.col("mention_id").cast("bigint").alias("mention_id"), F.col("text").alias("name")).where("name is not null")
    names = records.select("name", F.lit(True).alias("own")).unionByName(typed.select("name", F.lit(False).alias("own"))).groupBy("name").agg(F.max("own").alias("own"))
    parsed = cut(_parsed(names))
    every = parsed.select("own", F.explode("words").alias("word"))
    forms = cut(_forms(parsed, near_pairs(every, every.where("own"))))
    registered = cut(forms.where("registered").join(records, "name").groupBy("entity_id", "form", "kind", "middle").agg(F.min("cost").alias("cost")))
    asked = forms.where("not registered")
    alone = records.select("entity_id").distinct()

    # first round: records that share a strong rewriting; each form's records of one cost and middle name hang together by the least of them
    group = ["form", "cost", "middle"]
    least = registered.groupBy(*group).agg(F.min("entity_id").alias("rep")).select("form", F.col("cost").alias("o_cost"), F.col("middle").alias("o_middle"), "rep")
    strong = asked.where(F.col("own") & F.col("kind").isin(*STRONG)).join(least, "form").where(_middles_agree() & (F.col("cost") + F.col("o_cost") / 2 < 3))
    touched = strong.select("form", F.col("o_cost").alias("cost"), F.col("o_middle").alias("middle"), "rep").distinct()
    edges = strong.select("name", "rep").distinct().join(records, "name").select("entity_id", "rep").unionByName(touched.join(registered, group).select("entity_id", "rep"))
    first = _components(edges.where("entity_id <> rep").select(F.col("entity_id").alias("a"), F.col("rep").alias("b")).distinct(), alone)
    held = cut(registered.join(first, "entity_id").groupBy("form", "middle", "cluster").agg(F.min("cost").alias("o_cost")))

    # second round: records without a full name that stand alone, by what they leave out
    whole = registered.where("kind = 'full'").select("entity_id").distinct()
    lone = first.groupBy("cluster").agg(F.count("*").alias("n"), F.min("entity_id").alias("asker")).where("n = 1").select("asker")
    asking = cut(lone.join(whole, lone.asker == whole.entity_id, "left_anti").join(records.withColumnRenamed("entity_id", "asker"), "asker"))
    weak = _matches(asked.where(F.col("own") & ~F.col("kind").isin(*STRONG)).join(asking.select("name").distinct(), "name", "left_semi"), held, 3)
    bound = cut(_decided(weak.join(asking, "name").where("asker <> cluster"), "asker"))
    if bound.select("asker").intersect(bound.select("cluster")).isEmpty():
        clusters = first.join(bound.withColumnRenamed("cluster", "to"), first.cluster == bound.asker, "left")
        # the least id names a cluster: one that gets a record of a lower id is named anew
        lower = bound.groupBy("cluster").agg(F.min("asker").alias("l")).where("l < cluster").select(F.col("cluster").alias("c"), "l")
        clusters = clusters.select("entity_id", F.coalesce("to", "cluster").alias("cluster")).join(lower, F.col("cluster") == F.col("c"), "left").select("entity_id", F.coalesce("l", "cluster").alias("cluster"))
    else:
        clusters = _components(bound.select(F.col("asker").alias("a"), F.col("cluster").alias("b")).unionByName(first.where("entity_id <> cluster").select(F.col("entity_id").alias("a"), F.col("cluster").alias("b"))), alone)
    clusters = cut(clusters)
    new = first.join(clusters.withColumnRenamed("cluster", "now"), "entity_id").where("cluster <> now").select("cluster", "now").distinct()
    held = held.join(new, "cluster", "left").groupBy("form", "middle", F.coalesce("now", "cluster").alias("cluster")).agg(F.min("o_cost").alias("o_cost"))
    chosen = _decided(_matches(asked.join(typed.select("name").distinct(), "name", "left_semi"), held, 2), "name")
    return clusters, typed.join(chosen, "name").select("mention_id", "cluster").distinct()


def same_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of two entity records, or of a record and a mention, that name the same entity."""
    clusters, named = entity_clusters(entities, mentions)
    a = clusters.select(F.col("entity_id").alias("id_a"), "cluster")
    both = a.join(clusters.select(F.col("entity_id").alias("id_b"), "cluster"), "cluster").where("id_a < id_b").select("id_a", "id_b")
    linked = a.join(named, "cluster").select("id_a", F.col("mention_id").alias("id_b"))
    return both.unionByName(linked)
