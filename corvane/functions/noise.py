"""Noise of wiki and news pages in texts: signals, lines to drop, markers to cut, repeats to collapse. All are expressions over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: line ends, signals with their patterns, lines that are noise as a whole, and markers within a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
SIGNALS = (
    ("ui_edit_marker", r"\[\s*(?:원본\s*편집|소스\s*편집|편집)\s*\]"),
    ("ui_collapse_toggle", r"\[\s*(?:접기|펼치기|숨기기)\s*\]"),
    ("ui_recent_changes", r"최근\s*(?:변경|토론)"),
    ("ui_login_links", r"(?:로그인|회원가입|로그아웃)"),
    ("ui_history_link", r"역사\s*보기"),
    ("ui_category_footer", r"(?:^|\n)\s*분류\s*:\s*\S"),
    ("ui_redirect_notice", r"이\s*문서는[^\n]{0,80}리다이렉트"),
    ("ui_powered_by", r"(?i)Powered\s*by"),
    ("license_footer", r"(?i)CC\s*BY[\-\s]*NC[\-\s]*SA"),
    ("ad_phrase", r"(?:광고\s*문의|기사\s*제보|구독\s*하기|구독\s*신청)"),
    ("delimiter_run", r"-{4,}|={4,}|_{4,}|\*{4,}"),
)
WHOLE = (
    r"^\s*분류\s*:.*$",
    r"^\s*이\s*문서는[^\n]{0,80}리다이렉트.*$",
    r"(?i)^\s*Powered\s*by\b.*$",
    r"(?i)^\s*(?:라이선스|License)\s*:\s*CC\s*BY[\-\s\w]*.*$",
    r"(?i)^\s*CC\s*BY[\-\s]*NC[\-\s]*SA.*$",
    r"^\s*(?:광고\s*문의|기사\s*제보|구독\s*하기|구독\s*신청).*$",
    r"^\s*(?:최근\s*변경|최근\s*토론|역사\s*보기)\s*$",
    r"^\s*(?:로그인|회원가입|로그아웃)\s*$",
    r"^\s*[\-=_*]{4,}\s*$",
)
INLINE = (SIGNALS[0][1], SIGNALS[1][1])
#: Fixed: how often a line stands before it counts as repeated, from how many characters on, and blank lines on end that stay.
TIMES, LEAST, BLANKS = 3, 6, 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\s　]+", " ")) == ""


def is_noise(line: Column) -> Column:
    found = F.lit(False)
    for pattern in WHOLE:
        found = found | line.rlike(pattern)
    return found & ~blank(line)


def without_markers(line: Column) -> Column:
    for pattern in INLINE:
        line = F.regexp_replace(line, pattern, "")
    return F.regexp_replace(F.regexp_replace(line, "  +", " "), r"\s+$", "")


def collapsed_repeats(lines: Column) -> Column:
    """An array of lines in which one that stands `TIMES` times or more on end stands once; shorter lines than `LEAST` may repeat."""
    def stays(x: Column, i: Column) -> Column:
        at = lambda d: F.coalesce(F.get(lines, i + d) == x, F.lit(False))
        run = (at(-1) & at(-2)) | (at(-1) & at(1)) | (at(1) & at(2))
        return ~(at(-1) & run & (F.length(F.trim(x)) >= LEAST))

    return F.filter(lines, stays)


def limited_blanks(lines: Column) -> Column:
    """An array of lines with no more than `BLANKS` blank ones on end."""
    def stays(x: Column, i: Column) -> Column:
        before = F.lit(True)
        for d in range(1, BLANKS + 1):
            before = before & F.coalesce(blank(F.get(lines, i - d)), F.lit(False))
        return ~(blank(x) & before)

    return F.filter(lines, stays)


def repeated_lines(text: Column) -> Column:
    """How many lines repeat an equal one, among lines that stand `TIMES` times or more and have `LEAST` characters or more."""
    kept = F.array_sort(F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: F.length(x) >= LEAST))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("extra"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["last"] == x, a["n"] + 1).otherwise(1)
        extra = a["extra"] + F.when(n == TIMES, TIMES - 1).when(n > TIMES, 1).otherwise(0)
        return F.struct(x.alias("last"), n.alias("n"), extra.alias("extra"))

    return F.aggregate(kept, start, step, lambda a: a["extra"])


def signals(text: Column) -> Column:
    """An array of (signal, n) with all signals, those of repeated lines last."""
    text = F.coalesce(text, F.lit(""))
    found = [F.struct(F.lit(name).alias("signal"), F.regexp_count(text, F.lit(pattern)).alias("n")) for name, pattern in SIGNALS]
    return F.array(*found, F.struct(F.lit("repeated_sentence").alias("signal"), repeated_lines(text).alias("n")))
