"""Text scalars as column expressions; only diacritics and NFC need Python."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalith.constants import SHINGLE_WORDS, UNITS_PER_TOKEN


#: White space as text formats mean it, the byte order mark included.
BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


_BLANK_CHARS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(_BLANK_CHARS))


#: Letters and numbers are what ``\w`` holds besides the underscore.
_WORDS = re.compile(r"[^\W_]+")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC form; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def _fold(x: str | None) -> str | None:
    if x is None or x.isascii():
        return x
    marked = unicodedata.normalize("NFD", x)
    return unicodedata.normalize("NFC", "".join(c for c in marked if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Diacritics removed; null stays null."""
    return s.map(_fold)


def normalize(c: Column) -> Column:
    """Lower case, runs of anything but letters and numbers to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def words_of(c: Column) -> Column:
    """The words of a normalized text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def index_terms(c: Column) -> Column:
    """Terms of the full-text index: diacritics removed, lower case, runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(without_marks(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_terms(text: str) -> list[str]:
    """``index_terms`` of a text, in Python."""
    return _WORDS.findall((_fold(text) or "").lower())


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"))


def estimate_tokens(c: Column) -> Column:
    """The larger of UTF-16 units / 3.6, rounded up, and words between white space; 0 for an empty text."""
    return F.greatest(F.ceil(utf16_length(c) / F.lit(UNITS_PER_TOKEN)), word_count(c)).cast("int")


def estimate_tokens_py(text: str) -> int:
    units = len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2
    return max(math.ceil(units / UNITS_PER_TOKEN), len(text.split()))


def shingles(c: Column, k: int = SHINGLE_WORDS) -> Column:
    """Distinct runs of k words of a normalized text; the whole text if it has fewer; none without words."""
    w = words_of(c)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " ")))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def round6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def heading_prefix(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"))).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")
