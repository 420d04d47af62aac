import hashlib
import random

import pytest

from corvane.llm import fim


def plain_model(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slices."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(t), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_matches_slices_and_restores(spark):
    draw = random.Random(3)
    texts = ["", "a", "é😀é", "<P", "x<P>y", "S>", "<<P", "one\ntwo  three", "😀" * 9000] + ["".join(draw.choice("ab<>PSM é😀\n") for _ in range(draw.randrange(1, 6000))) for _ in range(60)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (70, None, "c"), (5, "again", "c"), (5, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string").repartition(3)
    out = fim.with_restored(fim.transformed(df)).collect()
    by_text = sorted((-1 if r.doc_id is None else r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out)
    assert by_text == sorted((-1 if i is None else i, *plain_model(i, t), t or "") for i, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transformed(df.limit(0)).collect() == []


@pytest.mark.parametrize("unit", [None, r"\w+\W*", r"[^\n]*\n"])
def test_ropes_split_and_join_at_every_rank(unit):
    draw = random.Random(5)
    text = "".join(draw.choice("ab é\n") for _ in range(200))
    own = fim.built(text, unit, size=3)
    assert str(own) == text and own.points == len(text)
    pieces = [0]
    for k in range(own.units + 1):
        a, b = fim.split(own, k)
        assert (a.units, b.units) == (k, own.units - k) and str(a) + str(b) == text
        assert a.points + b.points == len(text)
        again = fim.joined(a, b)
        assert str(again) == text and again.height <= 2 * max(1, again.units).bit_length()
        pieces.append(a.points)
    assert pieces == sorted(pieces)


def test_trees_stay_balanced():
    own = fim.Rope()
    for i in range(2000):
        own = fim.joined(own, fim.Rope(chr(97 + i % 26)))
    assert own.units == 2000 and own.height < 20
    for k in (1, 999, 1500):
        a, b = fim.split(own, k)
        own = fim.joined(b, a)
        assert own.height < 20


def test_units_of_a_pattern(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    for r in fim.with_restored(fim.transformed(df, unit=r"\w+\s*", plain=0)).collect():
        assert (r.n, r.restored) == (10, text) and r.form != "plain"
        prefix = text[: r.prefix_chars]
        assert prefix == "" or prefix.endswith(" ") or prefix == text
