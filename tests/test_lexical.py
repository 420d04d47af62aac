import random

import numpy as np
import pytest

from corvane.operators import lexical


def brute(docs, queries, k):
    """{(query, rank): (doc, score)} by scoring all documents."""
    words = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, text in queries:
        scores = {}
        for x in text.split():
            for i, w in words.items():
                if tf := w.count(x):
                    scores[i] = scores.get(i, 0) + np.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda p: (-round(p[1], 6), p[0]))[:k], 1):
            out[q, rank] = (i, round(s, 5))
    return out


def corpus(n=900):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(draw.choices(vocabulary, odds, k=draw.randrange(1, 60)))) for i in range(n)]
    docs += [(2000, None), (2001, ""), (2002, docs[0][1]), (2003, docs[0][1])]
    queries = [(i, " ".join(draw.choices(vocabulary, odds, k=draw.randrange(1, 9)))) for i in range(40)] + [(90, "unknown"), (91, "w0 w0 w299"), (92, docs[0][1])]
    return docs, queries


@pytest.mark.parametrize(("size", "terms", "k"), [(lexical.SEGMENT, lexical.TERMS, 10), (100, lexical.TERMS, 3), (256, 0, 20)])
def test_same_rows_as_all_scores(spark, size, terms, k):
    docs, queries = corpus()
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    own = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = lexical.bm25_topk(own, spark.createDataFrame(queries, "query_id long, text string"), k, size, seen, terms)
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 5)) for r in found.collect()}
    want = brute(docs, queries, k)
    assert got.keys() == want.keys()
    for at, (doc, score) in want.items():
        assert got[at][0] == doc and abs(got[at][1] - score) < 2e-5
    assert 0 < seen[0].value < seen[1].value


def test_many_slabs_and_empty_tables(spark, monkeypatch):
    docs, queries = corpus(200)
    own, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    whole = sorted(map(tuple, lexical.bm25_topk(own, asked, 5).collect()))
    monkeypatch.setattr(lexical, "SLAB", 7)
    assert sorted(map(tuple, lexical.bm25_topk(own, asked, 5).collect())) == whole
    assert lexical.bm25_topk(own.limit(0), asked).collect() == []
    assert lexical.bm25_topk(own, asked.limit(0)).collect() == []


def test_bounds_hold():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 50, 500)
    doc = np.repeat(np.arange(500), lengths)
    row = lexical._segment(np.arange(500), lengths, doc, draw.integers(0, 20, len(doc)))
    bound = lexical.impact(row["peaks"].astype(float), row["shortest"], 20.0)
    ends = np.append(row["starts"][1:], len(row["docs"]))
    for a, b, most in zip(row["starts"], ends, bound):
        assert lexical.impact(row["tfs"][a:b].astype(float), lengths[row["docs"][a:b]], 20.0).max() <= most + 1e-12
