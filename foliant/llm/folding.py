"""Text without marks: what stays of a letter when accents and invisible characters go."""

from __future__ import annotations

import sys
import unicodedata

#: Combining marks and format characters.
MARKS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c) or unicodedata.category(c) == "Cf")


def without_marks(text: str) -> str:
    """A text in compatibility form without MARKS; only the few distinct marks of a text are looked for."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text)
    for c in MARKS.intersection(text):
        text = text.replace(c, "")
    return text
