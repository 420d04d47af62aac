"""Text functions of retrieval and evaluation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what separates tokens, and a token: from the first letter or digit between blanks to the last.
BLANK = r"[ \t\n\r\x0b\x0c]+"
TOKEN = r"[\p{L}\p{N}](?:[^ \t\n\r\x0b\x0c]*[\p{L}\p{N}])?"
#: Fixed: stop words of keyword extraction.
STOP = ("of", "the", "a", "to", "in", "on", "for", "is", "이", "가", "을", "를", "은", "는", "의", "에", "와", "과")


def tokens(text: Column) -> Column:
    """Lower-cased words without the punctuation at their ends; repeated words stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalized(text: Column) -> Column:
    """Lower case, anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of characters; a shorter text is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(inner: Column, outer: Column) -> Column:
    """Share of the distinct elements of `inner` that `outer` has."""
    n = F.size(F.array_distinct(inner))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(inner, outer)) / n)


def keywords(text: Column, most: int = 10) -> Column:
    """The first distinct tokens of two characters or more that aren't stop words."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP))), 1, most)


def cer(got: Column, want: Column) -> Column:
    """Edit distance over the length of what is wanted, white space collapsed; with nothing wanted 0 for nothing got, else 1."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK, " "))
    none = F.when(F.length(flat(got)) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(F.length(flat(want)) == 0, none).otherwise(F.levenshtein(flat(got), flat(want)) / F.length(flat(want)))


def column_index(letters: Column) -> Column:
    """A spreadsheet column's number from its letters, three at most."""
    padded = F.lpad(letters, 3, "@")
    digit = lambda i: F.ascii(F.substring(padded, i, 1)) - 64
    return digit(1) * 676 + digit(2) * 26 + digit(3)


def cell_range(text: Column) -> Column:
    """(r0, c0, r1, c1) of an A1 range, in order; null if it isn't one."""
    pattern = r"^\$?([A-Z]+)\$?([0-9]+)(?::\$?([A-Z]+)\$?([0-9]+))?$"
    part = lambda i: F.regexp_extract(F.upper(text), pattern, i)
    c0, r0 = column_index(part(1)), part(2).cast("int")
    c1 = F.when(part(3) == "", c0).otherwise(column_index(part(3)))
    r1 = F.when(part(4) == "", r0).otherwise(F.nullif(part(4), F.lit("")).cast("int"))
    return F.when(F.upper(text).rlike(pattern), F.struct(F.least(r0, r1).alias("r0"), F.least(c0, c1).alias("c0"), F.greatest(r0, r1).alias("r1"), F.greatest(c0, c1).alias("c1")))


def overlaps(a: Column, b: Column) -> Column:
    return (a.r0 <= b.r1) & (b.r0 <= a.r1) & (a.c0 <= b.c1) & (b.c0 <= a.c1)


def contains_range(a: Column, b: Column) -> Column:
    return (a.r0 <= b.r0) & (a.r1 >= b.r1) & (a.c0 <= b.c0) & (a.c1 >= b.c1)


def preview(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
