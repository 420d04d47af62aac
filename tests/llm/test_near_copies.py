import random

import corpus_pipeline
import pytest

from corvane.llm import near_copies


def sets(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts)} if len(parts) < 5 else {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}


def brute(texts):
    """Least index reachable by links of Jaccard 0.8 or more, by comparing all pairs."""
    own = [sets(t) for t in texts]
    near = [[j for j, y in enumerate(own) if 5 * len(x & y) >= 4 * len(x | y)] for x in own]
    root = list(range(len(texts)))
    while (new := [min(root[j] for j in x) for x in near]) != root:
        root = new
    return root


def corpus(seed):
    """Copies of texts with words changed, so that similarities lie about 0.8, and a passage that many share."""
    draw = random.Random(seed)
    words = lambda n: [f"w{draw.randrange(2000)}" for _ in range(n)]
    passage, texts = words(20), []
    for _ in range(25):
        base = words(draw.choice([3, 6, 30, 100, 250])) + (passage if draw.random() < 0.5 else [])
        for _ in range(draw.choice([1, 3, 8])):
            own = list(base)
            for _ in range(draw.randrange(0, 2 + len(own) // 40)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9999)}"
            texts.append(" ".join(own))
    return texts + ["", None, "  \n", texts[3].upper(), texts[3], " ".join(passage)]


@pytest.mark.parametrize(("seed", "short"), [(1, near_copies.SHORT), (2, 2)])
def test_groups_match_brute_force(spark, seed, short):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = {r.doc_id: r.root for r in near_copies.grouped(docs, short=short).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(roots[i], i)
    assert [least[roots[i]] for i in range(len(texts))] == brute(texts)


def test_stage_keeps_one_of_each_group(spark, tmp_path):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect())
    assert got == sorted(set(brute(texts)))


def test_empty_table(spark):
    assert near_copies.grouped(spark.createDataFrame([], "doc_id long, text string")).collect() == []
