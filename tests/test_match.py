"""Forms of text that matching compares, against cases written by hand and plain loops."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import match as M
from corvane.functions import text as T


def values(spark, function, texts, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, x {kind}")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_bm25_tokens(spark):
    got = values(spark, M.bm25_tokens, ["Straße, ＡＢＣ! bge-m3", None, " \t", "안녕 세계", "日本語 text", "_x_ (y)", "a a"])
    assert [sorted(x) for x in got] == [sorted(x) for x in (["strasse", "abc", "bge-m3"], [], [], ["안녕", "안", "녕", "세계", "세", "계"], ["日本語", "日", "本", "語", "text"], ["x", "y"], ["a", "a"])]


def test_keys_and_hashes(spark):
    assert values(spark, M.document_key, ["Doc-01/Ａ b", None, "가나", ""]) == ["doc01ab", "", "", ""]
    one, two, blank, none, other = values(spark, M.text_hash, ["Some  TEXT\nhere", "some text here", " \n", None, "some text there"])
    assert one == two != other and len(one) == 16 and blank == none == ""
    long = "x" * 600
    assert len(set(values(spark, M.text_hash, [long, long + "y"]))) == 1


def test_match_forms(spark):
    assert values(spark, M.match_form, ["「Title」 ‘Q’: what?!", None, "Ｆｕｌｌ  width"]) == ["<title> 'q' what", "", "full width"]
    assert values(spark, M.semantic, ["Ab-c 가! é1", None]) == ["ab c 가 1", ""]
    assert values(spark, M.title_tokens, ["find 「Blue Star」 of Acme acme x12 [Z]", None, ""]) == [["Blue Star", "find", "Blue", "Star", "Acme", "x12"], [], []]
    assert values(spark, M.match_forms, [["A!", "?", "B c"], []], "array<string>") == [["a", "b c"], []]


def edits(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))


def test_error_rates(spark):
    draw = random.Random(1)
    pairs = [(" ".join(draw.choice("abc") for _ in range(draw.randrange(6))), " ".join(draw.choice("abc") for _ in range(draw.randrange(6)))) for _ in range(40)] + [("", ""), ("x", ""), (None, None), ("a b", "a  b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", M.wer("a", "b").alias("w"), T.cer(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = ((x or "").split() for x in pairs[r.i])
        assert r.w == pytest.approx(edits(a, b) / len(b) if b else float(bool(a)))
        a, b = " ".join(a), " ".join(b)
        assert r.c == pytest.approx(edits(a, b) / len(b) if b else float(bool(a)))


def test_folding_is_the_library_s(spark):
    texts = ["ﬁ Ⅳ ẞ İ", "Ångström", "ｶﾞ"]
    assert values(spark, M.folded, texts) == [unicodedata.normalize("NFKC", x).casefold() for x in texts]
