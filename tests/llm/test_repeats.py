import random

import pytest

from corvane.llm import repeats


def brute(rows):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] by a table of all 50-byte strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(first.get(t[a : a + 50], i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        runs = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), sum(gone), runs, bytes(t[j] for j in range(len(t)) if not gone[j])))
    return sorted(out)


def got(spark, rows, hot=repeats.HOT):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.removed(df, hot=hot).collect())


def corpus(seed, letters):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 130, 400)]
    rows = []
    for i in range(60):
        parts = [text(draw.randrange(0, 60))]
        for _ in range(draw.randrange(0, 4)):
            s = draw.choice(shared)
            a = draw.randrange(0, len(s))
            parts += [draw.choice([s, s[a:], s[:a]]), text(draw.randrange(0, 40))]
        rows.append((i * 7 % 61, "".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, rows[5][1]), (102, rows[6][1][:-3] + "é"), (103, "x" * 300), (104, "x" * 120), (105, "ab" * 90), (90, "ab" * 200)]
    return rows


@pytest.mark.parametrize(("letters", "hot"), [("abcdefgh é", repeats.HOT), ("ab", repeats.HOT), ("abcdefgh é", 5)])
def test_matches_brute_force(spark, letters, hot):
    rows = corpus(4, letters)
    assert got(spark, rows, hot) == brute(rows)


def test_edge_cases(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(70))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (None, long), (None, long + "z"), (4, "q" + long)]
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, TEXT string")
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in repeats.removed(df).collect())
    assert found == [(-1, 70, 70), (-1, 71, 70), (1, 0, 0), (2, 0, 0), (3, 5, 0), (4, 70, 0), (4, 71, 0)]
    assert repeats.removed(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [4, 9])
def test_matches_brute_force_in_turns_of_few_anchors(spark, seed):
    rows = corpus(seed, "abcdefgh é")
    line = "the same line stands in this text in several places, word for word\n"
    rows += [(200, line * 4 + "end of the first"), (201, "before " + line * 3), (202, line + "after " + line), (203, line * 4 + "end of the first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.removed(df, flush=7).collect())
    assert found == brute(rows)


def test_shared_tells_every_place():
    import numpy as np

    own, told = repeats.Shared(), []
    turns = [[(3, 0, 10, 0), (3, 0, 10, 1), (3, 1, 10, 0), (5, 0, 10, 2)], [(3, 0, 10, 7)], [(3, 2, 11, 0)], [(3, 2, 12, 5), (5, 0, 10, 9)]]
    for turn in turns:
        hashed, part, text, number = (np.array(x, np.int64) for x in zip(*turn, strict=True))
        told += [sorted(zip(*(x.tolist() for x in own.add(hashed.astype(np.uint64), part, text, number)), strict=True))]
    assert told == [[], [], [(0, 10, 0), (0, 10, 1), (0, 10, 7), (1, 10, 0), (2, 11, 0)], [(2, 12, 5)]]
    assert own.n[own.known].tolist() == [6]
