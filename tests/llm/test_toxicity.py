import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import toxicity


def table(spark, sf, name):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_held_out_accuracy(spark):
    labels = table(spark, "sf0.1", "labels")
    docs = table(spark, "sf0.1", "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in list(got)[:500])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    found = [got[i].predicted for i in held]
    right = [truth[i] for i in held]
    hits = sum(a and b for a, b in zip(found, right, strict=True))
    assert hits / sum(right) > 0.85 and hits / max(1, sum(found)) > 0.9


def test_nearest_is_exact():
    draw = np.random.default_rng(3)
    vec = lambda: (np.sort(draw.choice(40, 6, replace=False)), draw.integers(1, 5, 6).astype(float))
    vecs = [vec() for _ in range(500)]
    index = toxicity.Index(vecs, [i % 3 == 0 for i in range(500)], list(range(500)), np.linspace(0.5, 3, 40))
    dense = np.zeros((500, 40))
    for i, v in enumerate(vecs):
        at, w = index.unit(*v)
        dense[i, at] = w
    for q in [vec() for _ in range(50)]:
        at, w = index.unit(*q)
        want = np.sort(dense[:, at] @ w)[::-1][:10]
        places, cosines = index.nearest([(at, w)], 10)[0]
        assert np.allclose(cosines, want[want > 1e-12][: len(cosines)]) and len(cosines) == (want > 1e-12).sum()


def test_texts_against_brute_force(spark):
    """Vocabulary, frequencies, association and cosines of real texts, counted here by plain loops over all terms of all texts."""
    labels = table(spark, "sf0.01", "labels")
    docs = table(spark, "sf0.01", "documents")
    terms, index, _ = toxicity.fitted(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    bags = {}
    for i, text in texts.items():
        bags[i] = Counter()
        for word in re.findall(r"\w+", text.lower()):
            bags[i].update([word] if len(word) <= 5 else [word, word[:5] + "*"])
    assert terms == sorted({t for i in toxic for t in bags[i]})
    df = Counter(t for bag in bags.values() for t in bag)
    seen, hit = Counter(t for i in toxic for t in bags[i]), Counter(t for i in toxic if toxic[i] for t in bags[i])
    rows, ones = len(toxic), sum(toxic.values())

    def weight(term):
        cells = [(hit[term], seen[term], ones), (seen[term] - hit[term], seen[term], rows - ones), (ones - hit[term], rows - seen[term], ones), (rows - ones - seen[term] + hit[term], rows - seen[term], rows - ones)]
        g2 = 2 * sum(n * math.log(n * rows / (a * b)) for n, a, b in cells if n)
        return max(0.0, math.log((len(texts) + 1) / (df[term] + 0.5))) * math.sqrt(1 + max(0.0, g2))

    weights = {t: weight(t) for t in terms}
    assert np.allclose(index.factor, [weights[t] for t in terms])

    def unit(i):
        v = {t: (1 + math.log(n)) * weights[t] for t, n in bags[i].items() if t in weights}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    examples = {i: unit(i) for i in toxic}
    known = toxicity.Terms(terms)
    for q in list(texts)[::25]:
        own = unit(q)
        want = sorted((round(c, 9) for e in examples.values() if (c := sum(x * e.get(t, 0.0) for t, x in own.items())) > 1e-12), reverse=True)[:10]
        assert np.allclose(index.nearest([index.unit(*known.counts(texts[q]))], 10)[0][1], want)


@pytest.mark.parametrize("labelled", [True, False])
def test_edge_cases(spark, labelled):
    rows = [(1, "you stupid scum", "x"), (2, None, "x"), (None, "stupid", "y"), (4, "", "z"), (4, "stupid " * 20000, None), (1, "you stupid scum", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)] + [(1, None, None), (None, 1, 1)] if labelled else [], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), labels).collect() == []
