"""Scalar functions on text, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of address before and after a name.
HONORIFIC_SUFFIXES = ("kun", "chan", "san", "sama", "dono", "sensei", "senpai", "sempai", "tan")
HONORIFIC_TITLES = ("mr", "mrs", "ms", "miss", "dr", "lord", "lady", "sir", "master", "madam", "madame")
# Media type by file suffix.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normal_name(c: Column | str) -> Column:
    """Key under which names compare equal: lower case, single spaces, trimmed."""
    return F.lower(strip(collapse(c)))


def squash(c: Column | str) -> Column:
    """Letters and digits of the ASCII range only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def estimated_tokens(c: Column | str) -> Column:
    """A quarter of the code points, rounded up; 0 for an empty text, null for a null."""
    n = F.length(c)
    return F.when(n == 0, 0).when(n > 0, F.ceil(n / 4)).cast("int")


def keeps_source(c: Column | str) -> Column:
    """Whether a text needs no translation: it has no letter, or is one URL."""
    t = strip(c)
    return ~t.rlike(r"\p{L}") | t.rlike(r"(?i)^(https?://|www\.)\S+$")


def kept_source(sources: Column, translations: Column) -> Column:
    """Translations with the source where it needs none; arrays of another length stay as they are."""
    return F.when(F.size(sources) == F.size(translations), F.zip_with(sources, translations, lambda s, t: F.when(F.coalesce(keeps_source(s), F.lit(False)), s).otherwise(t))).otherwise(translations)


def paragraph_count(c: Column | str) -> Column:
    """Lines of a text, 0 for an empty one."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "", 0).otherwise(F.size(F.split(col, "\n", -1)))


def name_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def core_words(c: Column | str) -> Column:
    """Words of a name without titles before and terms of address after it, at least one word."""
    words = name_words(c)
    suffixes, titles = (F.array(*map(F.lit, x)) for x in (HONORIFIC_SUFFIXES, HONORIFIC_TITLES))
    # length of the name without trailing suffixes: after the last word that is none, but at least one word
    kept = F.aggregate(words, F.struct(F.lit(0).alias("i"), F.lit(1).alias("keep")), lambda acc, w: F.struct(
        (acc["i"] + 1).alias("i"), F.when(F.array_contains(suffixes, w), acc["keep"]).otherwise(acc["i"] + 1).alias("keep")))["keep"]
    body = F.slice(words, 1, F.greatest(kept, F.lit(1)))
    lead = F.aggregate(body, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, w: F.struct(
        F.when(acc["on"] & F.array_contains(titles, w), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & F.array_contains(titles, w)).alias("on")))["n"]
    start = F.least(lead, F.size(body) - 1)
    return F.when(F.size(words) == 0, words).otherwise(F.slice(body, start + 1, F.size(body)))


def display_name(c: Column | str) -> Column:
    """A name as written, without titles before and terms of address after it; unchanged where nothing would be left."""
    t = strip(c)
    out = F.regexp_replace(t, rf"(?i)^(?:(?:{'|'.join(HONORIFIC_TITLES)})\.?\s+)+(?=\S)", "")
    out = strip(F.regexp_replace(out, rf"(?i)(?<=\S)(?:(?:-|\s)(?:{'|'.join(HONORIFIC_SUFFIXES)}))+$", ""))
    return F.when(out == "", t).otherwise(out)


def contains_word(text: Column, term: Column) -> Column:
    """Whether a term stands in a text with no letter or digit on either side."""
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(term, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)"))), F.lit(False))


def numbered(prefix: str, width: int, n: Column) -> Column:
    """An identifier of a prefix and a zero-padded number."""
    return F.format_string(f"{prefix}%0{width}d", n.cast("int"))


def unfenced_json(c: Column | str) -> Column:
    """The body of a fenced code block, or the text itself."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def resolved_path(base: Column, relative: Column) -> Column:
    """A relative path joined to a base folder, with `.`, `..` and empty parts resolved."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def backoff_seconds(retry_after: Column, attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Delay before a retry: what the server asked for, else base doubled with each attempt; capped."""
    return F.least(F.coalesce(retry_after.cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt)), F.lit(cap))


def media_type(name: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, suffix), F.lit("application/octet-stream"))


def safe_title(c: Column | str) -> Column:
    """A title as a file name: characters that file systems refuse become spaces; `novel` where nothing is left."""
    out = strip(collapse(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', " ")))
    return F.when(out == "", "novel").otherwise(out)


def label_title(title: Column) -> Column:
    """`Chapter N` with its Indonesian label; null for a title with more than the label."""
    return F.when(strip(title).rlike(r"(?i)^chapter\s+\d+$"), F.concat(strip(title), F.lit(" (Bab "), F.regexp_extract(title, r"(\d+)", 1), F.lit(")")))


def title_error(source: Column, translated: Column) -> Column:
    """Why a translated title is refused, null if it is not: prefix, number, parenthesis, empty or label."""
    pattern = r"(?is)^(Chapter\s+\d+\s*:\s*)(.+)$"
    s, t = strip(source), strip(translated)
    body = strip(F.regexp_extract(t, pattern, 2))
    inner = strip(F.regexp_extract(body, r"(?s)^.+\(([^(]*)\)$", 1))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1)
    return (
        F.when(~s.rlike(pattern), None)
        .when(~t.rlike(pattern), "prefix")
        .when(number(s) != number(t), "number")
        .when(~body.endswith(")") | ~body.rlike(r"(?s)^.+\([^(]*\)$"), "parenthesis")
        .when(inner == "", "empty")
        .when(inner.rlike(r"(?i)^chapter\s+\d+$"), "label")
    )
