"""Text in the forms that matching compares. Unicode's compatibility form and case folding have no function in Spark, so an Arrow batch function makes
them; all that follows is expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from corvane.functions.text import TOKEN

#: Fixed: characters that are tokens of their own beside their word: Hangul, Han, Kana.
CJK = "[가-힯ᄀ-ᇿ㄰-㆏一-鿿㐀-䶿぀-ゟ゠-ヿ]"
#: Fixed: brackets and quotes that count as plain ones, and punctuation that counts as a space.
BRACKETS = {"「": "<", "」": ">", "『": "<", "』": ">", "〈": "<", "〉": ">", "《": "<", "》": ">", "（": "(", "）": ")", "｛": "{", "｝": "}", "［": "[", "］": "]"}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"'}
PUNCTUATION = r"[?!,.;:`~]+"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFKC."""
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding."""
    return text.map(lambda x: None if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


def bm25_tokens(text: Column) -> Column:
    """Words without the marks at their ends, repeated ones too, then all characters that are tokens of their own."""
    flat = folded(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(flat, F.lit(TOKEN), F.lit(0)), F.regexp_extract_all(flat, F.lit(CJK), F.lit(0)))


def document_key(raw: Column) -> Column:
    """An id without its case, width and separators."""
    return F.regexp_replace(folded(F.coalesce(raw, F.lit(""))), "[^0-9a-z]+", "")


def text_hash(text: Column, most: int = 512) -> Column:
    """16 hex digits of the first characters of the folded text with single spaces; empty for a blank text."""
    flat = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), SPACE, " "))
    return F.when(flat == "", "").otherwise(F.substring(F.sha1(F.substring(flat, 1, most).cast("binary")), 1, 16))


def semantic(text: Column) -> Column:
    """Hangul, Latin letters and digits in lower case, anything else a space."""
    kept = F.regexp_replace(composed(F.coalesce(text, F.lit(""))), r"[^ㄱ-ㆎ가-힣A-Za-z0-9\s]+", " ")
    return F.trim(F.regexp_replace(F.lower(kept), r"\s+", " "))


def plain_marks(text: Column) -> Column:
    """Brackets and quotes made plain, punctuation to a space; the case stays."""
    marks = BRACKETS | QUOTES
    flat = F.translate(F.coalesce(text, F.lit("")), "".join(marks), "".join(marks.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, PUNCTUATION, " "), r"\s+", " "))


def match_form(text: Column) -> Column:
    return F.lower(plain_marks(composed(F.coalesce(text, F.lit("")))))


def match_forms(values: Column) -> Column:
    """The match forms of an array without empty ones; values are joined for the batch function and parted again."""
    parts = F.split(match_form(F.array_join(values, " \x00 ")), "\x00")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def title_tokens(query: Column, least: int = 2) -> Column:
    """What stands in brackets, then Latin words of three letters or more, each once in any case."""
    flat = plain_marks(query)
    inside = F.transform(F.regexp_extract_all(flat, F.lit(r"[<(\[{]([^<>()\[\]{}]+)[>)\]}]"), F.lit(1)), lambda x: F.trim(x))
    words = F.filter(F.regexp_extract_all(flat, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)), lambda x: F.length(x) >= max(least, 3))
    every = F.filter(F.concat(F.filter(inside, lambda x: F.length(x) >= least), words), lambda x: x != "")
    low = F.transform(every, lambda x: F.lower(x))
    return F.transform(F.array_distinct(low), lambda x: F.element_at(every, F.array_position(low, x).cast("int")))


def _steps(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two sequences, one row of the table at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@F.pandas_udf(DoubleType())
def wer(got: pd.Series, want: pd.Series) -> pd.Series:
    """Word error rate: edits over the number of words wanted; with none wanted 0 for none got, else 1."""
    def one(a: str | None, b: str | None) -> float:
        a, b = (a or "").split(), (b or "").split()
        return _steps(a, b) / len(b) if b else float(bool(a))

    return pd.Series([one(a, b) for a, b in zip(got, want, strict=True)])
