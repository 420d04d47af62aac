"""Chunkers and cleaning against cases written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import noise
from corvane.operators import chunking as C


def test_packed_by_hand():
    text = "Aa bb. Cc dd. Ee ff gg. Hh."
    assert C.packed(text, least=6, most=14, overlap=4) == ["Aa bb. Cc dd.", "dd. Ee ff gg.", "gg. Hh."]
    assert C.packed(text, least=14, most=14, overlap=4) == ["Aa bb. Cc dd.", "Ee ff gg. Hh."]
    assert C.packed("one two three four five six", least=4, most=10, overlap=3) == ["one two", "three four", "five six"]
    assert C.packed("Ab. " + "word " * 5 + "end", least=2, most=10, overlap=2) == ["Ab.", "word word", "word word", "word end", "b."]
    assert C.packed(" \n") == C.packed(None) == C.packed("") == []
    assert C.packed("y" * 5000) == ["y" * 5000]


def test_packed_at_random():
    draw = random.Random(2)
    for _ in range(100):
        text = " ".join("w" * draw.randrange(1, 9) + draw.choice(["", "", ".", "!"]) for _ in range(draw.randrange(1, 400)))
        chunks = C.packed(text, least=40, most=90, overlap=0)
        assert " ".join(chunks).split() == text.split() and all(len(x) <= 108 for x in chunks)


def test_rewindowed_by_hand():
    assert C.rewindowed(["aaaa", "bbbb", "cccc"], target=9, least=4, most=9, overlap=2) == ["aaaa bbbb", "bb cccc"]
    assert C.rewindowed(["aaaaaaaa", "b", " ", None, "cccccccc"], target=9, least=20, most=9, overlap=0) == ["aaaaaaaa", "b cccccccc"]
    assert C.rewindowed([]) == []


def test_sections():
    assert C.section_chunks(["one"], [("n", "d"), (None, "only said"), ("only name", " ")], "unused text") == ["one n: d only said only name"]
    assert C.section_chunks(None, None, "A text. Of two.") == ["A text. Of two."] and C.section_chunks([], [], None) == []


def test_token_chunks_by_hand():
    budget = C.Budget(target=4, soft=5, hard=8, shared=0)
    assert C.token_chunks("a b c", budget) == [("a b c", 3, "short", False)]
    assert C.token_chunks("a b c\n\nd e f\n\ng", budget) == [("a b c", 3, "paragraph", False), ("d e f\n\ng", 4, "paragraph", False)]
    assert C.token_chunks("a b c\nd e f", budget) == [("a b c", 3, "line_break", False), ("d e f", 3, "line_break", False)]
    assert C.token_chunks("- a b c\n- d e f", budget)[0] == ("- a b c", 4, "line_bullet", False)
    assert C.token_chunks("a b c. d e f.", budget) == [("a b c.", 3, "sentence", False), ("d e f.", 3, "sentence", False)]
    cut = C.token_chunks("aaaa " * 20, budget)
    assert all(kind == "hard_char" and done for _, _, kind, done in cut) and "".join("".join(x[0].split()) for x in cut) == "aaaa" * 20
    with pytest.raises(ValueError):
        C.Budget(target=9, soft=5)


def test_token_chunks_with_a_tokenizer():
    budget = C.Budget(target=4, soft=5, hard=8, shared=2, encode=str.split, decode=" ".join)
    text = " ".join(f"w{i}" for i in range(11))
    assert [x[0] for x in C.token_chunks(text, budget)] == ["w0 w1 w2 w3", "w2 w3\n\nw4 w5 w6 w7", "w6 w7\n\nw8 w9 w10"]
    assert {x[2] for x in C.token_chunks(text, budget)} == {"hard_token"}


def test_token_chunks_hold_the_budget():
    draw = random.Random(3)
    for _ in range(60):
        text = "".join(draw.choice(["word ", "word. ", "\n", "\n\n", "- item ", "longerword "]) for _ in range(draw.randrange(1, 600)))
        chunks = C.token_chunks(text, C.Budget(target=20, soft=30, hard=40, shared=0))
        assert all(n <= 40 and n == len(x.split()) for x, n, _, _ in chunks)
        assert "".join("".join(x.split()) for x, *_ in chunks) == "".join(text.split())


def test_lines(spark):
    def run(function, lines):
        return spark.createDataFrame([(lines,)], "l array<string>").select(function(F.col("l"))).first()[0]

    assert run(noise.limited_blanks, ["a", "", " ", "", "", "b", ""]) == ["a", "", " ", "b", ""]
    assert run(noise.collapsed_repeats, ["same line"] * 3 + ["same line "] + ["xy"] * 4) == ["same line", "same line "] + ["xy"] * 4
    lines = ["분류: 동물", "Powered by X", "----", "본문 [편집] 이다", "로그인", "License: CC BY-SA", "plain", ""]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(noise.is_noise(F.col("x")).alias("n"), noise.without_markers(F.col("x")).alias("t")).collect()
    assert [r.n for r in got] == [True, True, True, False, True, True, False, False] and got[3].t == "본문 이다"


def test_signals(spark):
    text = "[편집] 최근 변경\n분류: a\nlong line\nlong line\n long line\nab\nab\nab\n===== CC BY-NC-SA"
    got = {r.s.signal: r.s.n for r in spark.createDataFrame([(text,)], "x string").select(F.explode(noise.signals(F.col("x"))).alias("s")).collect()}
    assert {k: v for k, v in got.items() if v} == {"ui_edit_marker": 1, "ui_recent_changes": 1, "ui_category_footer": 1, "license_footer": 1, "delimiter_run": 1, "repeated_sentence": 2}
