"""Diacritic-insensitive folding and tokenizing of names, for search.

``fold`` decomposes, drops combining marks of five ranges, maps a few letters that do
not decompose, lower-cases character by character and composes again.  Characters of
the Latin blocks fold one by one, so for texts of ASCII and those blocks the fold is a
``translate`` inside the JVM; only other texts are sent to Python.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that do not decompose, and the ranges of dropped marks.
LETTERS = {"đ": "d", "Đ": "d", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ß": "ss", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th"}
MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")

#: Code points whose fold depends on no neighbour (Latin blocks, and the marks themselves).
_LATIN = [*range(0xA0, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00)]
_LATIN_ONLY = "^[\\x00-\\x7F\\u00A0-\\u024F\\u0300-\\u036F\\u1E00-\\u1EFF]*$"


def fold_text(text: str) -> str:
    """The fold of one string, for queries and as the definition."""
    if text.isascii():
        return text.lower()
    bare = MARKS.sub("", unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", "".join(LETTERS.get(c) or c.lower() for c in bare))


def _latin_table() -> tuple[str, str, list[tuple[str, str]]]:
    """What ``translate`` and ``replace`` need, derived from the fold itself."""
    one, gone, more = [], [], []
    for c in map(chr, _LATIN):
        to = fold_text(c)
        if len(to) == 1 and to != c:
            one.append((c, to))
        elif not to:
            gone.append(c)
        elif len(to) > 1:
            more.append((c, to))
    return "".join(c for c, _ in one) + "".join(gone), "".join(t for _, t in one), more


_FROM, _TO, _LONGER = _latin_table()


@F.pandas_udf(StringType())
def _fold_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_text(t))


def fold(text: Column) -> Column:
    """Folded text; null stays null. Python sees only the texts that need it (the others reach it as null)."""
    latin = (F.octet_length(text) == F.length(text)) | text.rlike(_LATIN_ONLY)
    return F.coalesce(F.when(latin, fold_native(text)), _fold_any(F.when(~latin, text)))


def fold_native(text: Column) -> Column:
    """The fold of texts of ASCII and Latin letters, without Python; other characters stay as they are."""
    ascii_only = F.octet_length(text) == F.length(text)
    longer = text
    for c, to in _LONGER:
        longer = F.replace(longer, F.lit(c), F.lit(to))
    spread = F.when(text.rlike(f"[{''.join(c for c, _ in _LONGER)}]"), longer).otherwise(text)
    a_z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _FROM, "abcdefghijklmnopqrstuvwxyz" + _TO)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(spread, *a_z))


def tokenize(folded: Column) -> Column:
    """Runs of letters and digits (Unicode Alphabetic or Numeric), in order, with repeats."""
    return F.regexp_extract_all(folded, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))


def tokenize_text(folded: str) -> list[str]:
    """The same for a query on the driver."""
    try:
        import regex

        return regex.findall(r"[\p{Alphabetic}\p{N}]+", folded)
    except ImportError:
        words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded)
        return words.split()
