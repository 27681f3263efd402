"""Functions on markup and on the answers of models and settings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as T


def mark_indonesian(html: Column) -> Column:
    """English language marks of a page as Indonesian ones."""
    return F.regexp_replace(html, r'((?:xml:)?lang=)(["\'])en(?:-[A-Za-z]+)?\2', "$1$2id$2")


# Fixed values and patterns: style of a centred image, openings of chapter labels, the sign of a line break in a title, and where a
# closing quote is missing.
IMAGE_STYLE = "display:block;margin:0 auto;width:100%;height:auto"
LABEL_OPENINGS = ("Bab", "Chapter", "Extra Chapter")
TITLE_BREAK = "\u241e"
_OPEN_QUOTE = r'(="[^"<>\n]*?)/>'


def repaired(html: Column) -> Column:
    """A page with the quote closed that is missing before the end of an empty element."""
    return F.regexp_replace(html, _OPEN_QUOTE, '$1"/>')


def repairs(html: Column) -> Column:
    """How many quotes `repaired` closes."""
    return F.regexp_count(html, F.lit(_OPEN_QUOTE))


def centered_images(html: Column) -> Column:
    """A page whose images fill the width and are centred; a style of an image's own stands behind that."""
    styled = F.regexp_replace(html, r'(<img\b[^>]*?\sstyle=")', f"$1{IMAGE_STYLE};")
    return F.regexp_replace(styled, r'<img\b(?![^>]*\sstyle=")([^>]*?)(/?)>', f'<img$1 style="{IMAGE_STYLE}"$2>')


def stylesheet_links(html: Column) -> Column:
    """Targets of a page's stylesheet links, in order."""
    links = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    sheets = F.filter(links, lambda x: x.rlike(r'(?i)\brel\s*=\s*["\'][^"\']*\bstylesheet\b'))
    return F.filter(F.transform(sheets, lambda x: F.regexp_extract(x, r'(?i)\bhref\s*=\s*["\']([^"\']*)["\']', 1)), lambda h: h != "")


_LABEL = rf"^((?:{'|'.join(LABEL_OPENINGS)})[^:]*?):\s*"


def chapter_label(title: Column) -> Column:
    """The label of `Bab N: name`, empty where there is none."""
    return T.strip(F.regexp_extract(title, _LABEL, 1))


def without_label(title: Column) -> Column:
    return F.regexp_replace(title, _LABEL, "")


def title_lines(title: Column) -> Column:
    """A title with its label on a line of its own."""
    return F.when(title.rlike(_LABEL), F.concat(chapter_label(title), F.lit(TITLE_BREAK), without_label(title))).otherwise(title)


def coerced(value: Column, kind: str) -> Column:
    """A setting as a bool, int, double or string; null where it cannot be read."""
    return truth(value) if kind == "bool" else T.strip(value) if kind == "string" else T.strip(value).try_cast(kind)


def safe_name(value: Column) -> Column:
    """Whether a name given from outside stays inside its folder."""
    return F.coalesce((T.strip(value) != "") & ~value.rlike(r"[/\\\x00]") & ~value.rlike(r"^\.+$"), F.lit(False))


def download_name(title: Column, suffix: Column) -> Column:
    return F.concat(T.safe_title(title), F.lit("."), F.lower(suffix))


def truth(value: Column) -> Column:
    """A setting as a boolean: 1, true, yes, on; null stays null."""
    return F.when(value.isNotNull(), F.lower(T.strip(value)).isin("1", "true", "yes", "on"))


def share(value: Column) -> Column:
    """A confidence in [0, 1]; what is no number is 0."""
    x = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def valid_indices(indices: Column, n: Column) -> Column:
    """Those of a model's chosen indices that lie in the list they choose from, once each, in order."""
    return F.array_distinct(F.filter(F.coalesce(indices, F.array().cast("array<int>")), lambda i: (i >= 0) & (i < n)))


def spine_answer(kind: Column) -> Column:
    """A model's classification; null where it names none of the three."""
    k = F.lower(T.strip(kind))
    return F.when(k.isin("front_matter", "chapter", "ambiguous"), k)
