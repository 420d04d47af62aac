import random

import duckdb
import numpy as np
import pytest

from corvane.llm import debruijn

K = debruijn.WORDS


def brute(rows):
    """[(doc_id, n_words, n_removed, kept)] by a table of all windows."""
    last = debruijn.LAST
    words = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - K + 1):
            first[tuple(w[a : a + K])] = min(first.get(tuple(w[a : a + K]), i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - K + 1):
            if first[tuple(w[a : a + K])] < i:
                gone[a : a + K] = [True] * K
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def got(df):
    return sorted((debruijn.LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in debruijn.removed(df).collect())


def corpus(seed, vocabulary):
    draw = random.Random(seed)
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    shared = [some(n) for n in (12, 13, 14, 20, 40, 200)]
    rows = []
    for i in range(80):
        parts = some(draw.randrange(0, 20))
        for _ in range(draw.randrange(0, 4)):
            s = draw.choice(shared)
            a = draw.randrange(0, len(s))
            parts += draw.choice([s, s[a:], s[:a]]) + some(draw.randrange(0, 12))
        rows.append((i * 7 % 81, draw.choice([" ", "\n", " \t "]).join(parts)))
    same = " ".join(some(60))
    rows += [(100 + i, same) for i in range(30)] + [(200, rows[5][1]), (201, rows[5][1] + " more"), (201, rows[5][1]), (90, "a b " * 40), (95, "b a " * 30), (96, "x " * 50), (97, "x " * 14)]
    return rows


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, [f"w{i}é" for i in range(500)]), (2, ["a", "b"]), (3, [chr(97 + i) for i in range(12)])])
@pytest.mark.parametrize("chunk", [debruijn.CHUNK, 300])
def test_matches_brute_force(spark, monkeypatch, seed, vocabulary, chunk):
    rows = corpus(seed, vocabulary)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if chunk != debruijn.CHUNK:  # workers are forked after the change only where they are new: take the steps here
        monkeypatch.setattr(debruijn, "CHUNK", chunk)
        check_steps(rows)
    else:
        assert got(df) == brute(rows)


def check_steps(rows):
    """Without Spark: pieces of the chunks' paths cover each repeated window once, with its source."""
    rows = [(i, t.encode()) for i, t in rows]
    bodies = []
    for start in range(0, len(rows), 7):
        some = rows[start : start + 7]
        own = debruijn.Windows([t for _, t in some])
        found = debruijn.compacted(own, np.arange(len(own.doc)), np.array([i for i, _ in some]), np.arange(start, start + len(some)))
        if found is not None:
            bodies.append(debruijn._packed([found[k].astype(kind) for k, kind in debruijn.KINDS.items()]))
    out = debruijn._pieces(list(range(len(bodies))), bodies)
    windows: dict = {}
    for i, t in rows:
        own = debruijn.Windows([t])
        for k, place in zip(own.key.view(np.int64).tolist(), own.place.tolist()):
            windows.setdefault(k, []).append((i, place))
    repeated = {k for k, v in windows.items() if len({i for i, _ in v}) > 1}
    at = {rid: debruijn.Windows([t]) for rid, (_, t) in enumerate(rows)}
    covered = set()
    for key, n, did, rid, pos in zip(*(out[k].tolist() for k in ("key", "n", "did", "rid", "pos"))):
        path = at[rid].key.view(np.int64)[pos : pos + n].tolist()
        assert path[0] == key and rows[rid][0] == did
        assert all(min(windows[k])[0] == did and k in repeated for k in path)
        covered |= set(path)
    assert covered == repeated


def test_paths_have_their_sources(spark):
    rows = corpus(1, [f"w{i}" for i in range(500)])
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t.split())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = 0
    for r in debruijn.removed(df).collect():
        for a, size, source, pos in zip(*(r.sources[i::4] for i in range(4))):
            assert source < r.doc_id and any(own[a : a + size] in [w[pos : pos + size] for w in text[source]] for own in text[r.doc_id])
            n += 1
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
    assert n


def test_paths_are_joined(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, "x " + " ".join(words) + " y"), (3, " ".join(words[100:200])), (4, "z")]
    for r in debruijn.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if r.doc_id == 2:  # one path up to the third's beginning, that text, and one from its end
            assert r.sources == [1, 112, 1, 0, 101, 100, 1, 100, 189, 212, 1, 188]
        if r.doc_id == 3:
            assert r.sources == [0, 100, 1, 100] and r.n_removed == 100


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (None, long), (None, long + " z"), (4, "q " + long), (5, "few words")]
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, TEXT string")
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in debruijn.removed(df, scan=True).collect())
    assert found == [(-1, 20, 20), (-1, 21, 20), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 20, 0), (4, 21, 0), (5, 2, 0)]
    assert debruijn.removed(df.limit(0)).collect() == []


def test_sql_agrees_on_repeats(spark, tmp_path):
    rows = corpus(3, [chr(97 + i) for i in range(12)]) + [(None, "a b c " * 9), (300, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = debruijn.query(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, con.execute(debruijn.SQL).fetchall()))
