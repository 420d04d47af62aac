"""Wiki pages made ready: the block before a page's text, edit markers, aliases, names and shown cell values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corvane.functions.noise import INLINE

#: Fixed: where a page's block of notes begins, what may follow it, how far it is looked for and cut, and from which share on a text is dropped.
ANCHOR = r"최근\s*수정\s*시각\s*:\s*\d{4}[-./]\d{2}[-./]\d{2}\s+\d{2}:\d{2}:\d{2}(?:\s*\d{1,5})?"
NOTES = (r"편집\s*권한[^.\n]{0,80}\.", r"로그인[된]?\s*사용자[^.\n]{0,80}\.", r"해당\s*문서의\s*ACL[^.\n]{0,80}\.", r"ACL\s*탭[^.\n]{0,80}\.", r"이\s*문서[가에는는]?\s*스포일러[^.\n]{0,150}\.", r"이\s*문서가\s*설명[^.\n]{0,300}\.", r"\[\s*편집\s*요청\s*도움말\s*\]", r"편집\s*요청\s*닫기", r"(?:편집(?:\s*요청)?|토론|역사|분류|닫기)", r"\[\s*(?:펼치기|접기|숨기기)[^\]]{0,30}\]", r"\[\s*(?:원본\s*편집|소스\s*편집|편집)\s*\]", "·")
HEAD, STEPS, DROP = 3000, 40, 0.8
BLOCK = re.compile(ANCHOR + rf"(?:\s*(?:{'|'.join(NOTES)})){{0,{STEPS}}}")
HANGUL, LATIN = "[가-힣]", "[A-Za-z]"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("cut", IntegerType())]))
def without_block(text: pd.Series) -> pd.DataFrame:
    """The text after its page's block of notes, and how many characters that had; a block that begins after the first 3,000 isn't one."""
    def end(x: str | None) -> int:
        found = BLOCK.search(x or "")
        return min(found.end(), HEAD) if found and re.search(ANCHOR, x[:HEAD]) else 0

    ends = [end(x) for x in text]
    return pd.DataFrame({"text": [x if not n else x[n:].lstrip() for x, n in zip(text, ends, strict=True)], "cut": ends})


def without_edit_marks(text: Column) -> Column:
    """The text without edit markers, the blanks that these leave closed up."""
    gone = F.regexp_replace(text, INLINE[0], "")
    closed = F.regexp_replace(F.regexp_replace(F.regexp_replace(gone, "  +", " "), " +\n", "\n"), "\n +", "\n")
    return F.when(text.rlike(INLINE[0]), closed).otherwise(text)


def prepared(text: Column) -> Column:
    """(text, cut, marks, dropped): without block and markers; dropped if the block was 0.8 of the text or more."""
    parted = without_block(text)
    share = parted["cut"] / F.greatest(F.length(text), F.lit(1))
    return F.struct(F.when(share >= DROP, "").otherwise(without_edit_marks(parted["text"])).alias("text"), parted["cut"].alias("cut"), F.regexp_count(parted["text"], F.lit(INLINE[0])).alias("marks"), (share >= DROP).alias("dropped"))


def looks_like_alias(words: Column, titles: Column) -> Column:
    """Words in one script where all titles are in the other, so that no part of one is in the other."""
    any_of = lambda xs, p: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")).rlike(p))
    across = lambda p, q: any_of(words, p) & ~any_of(titles, p) & any_of(titles, q)
    return across(LATIN, HANGUL) | across(HANGUL, LATIN)


def translated(text: Column, terms: dict[str, str]) -> Column:
    """Phrases replaced by their terms, longer ones first."""
    for phrase in sorted(terms, key=len, reverse=True):
        text = F.replace(text, F.lit(phrase), F.lit(terms[phrase]))
    return text


def shown(value: Column, form: Column) -> Column:
    """A cell's number as its format shows it: per cent, thousands, fixed places, or plain without empty places."""
    places = F.length(F.regexp_extract(form, r"\.(0+)", 1))
    fixed = lambda x: F.when(places == 0, F.format_number(x, 0)).when(places == 1, F.format_number(x, 1)).otherwise(F.format_number(x, 2))
    bare = lambda x: F.replace(fixed(x), F.lit(","), F.lit(""))
    plain = F.regexp_replace(value.cast("decimal(28,10)").cast("string"), r"\.?0+$", "")
    return F.when(value.isNull(), "").when(F.contains(form, F.lit("%")), F.concat(bare(value * 100), F.lit("%"))).when(F.contains(form, F.lit("#,##0")), fixed(value)).when(form.rlike(r"^0(\.0+)?$"), bare(value)).otherwise(plain)
