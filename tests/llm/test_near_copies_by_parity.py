import random

import numpy as np
from corvane.llm import near_copies
from test_near_copies import brute


def test_parities_never_rule_out_a_pair_at_the_least_similarity():
    draw = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(3000):
        shared, a, b = int(draw.integers(0, 900)), int(draw.integers(0, 150)), int(draw.integers(0, 150))
        own = draw.integers(0, 2**64, shared + a + b, dtype=np.uint64)
        x, y = np.unique(own[: shared + a]), np.unique(np.concatenate([own[:shared], own[shared + a :]]))
        apart = near_copies.unshared(near_copies.parities(x), near_copies.parities(y))
        n, m, both = len(x), len(y), len(np.intersect1d(x, y))
        assert apart <= n + m - 2 * both
        possible = near_copies.alike(np.array([(n + m - apart) // 2]), np.array([n]), np.array([m]))[0]
        assert possible or not near_copies.alike(np.array([both]), np.array([n]), np.array([m]))[0]
        ruled_out += not possible
    assert ruled_out > 300


def test_parities_of_no_shingles():
    none = near_copies.parities(np.empty(0, np.uint64))
    assert near_copies.unshared(none, none) == 0


def test_whole_sets_are_made_for_possible_pairs_only(spark, monkeypatch):
    """Texts of four passages, each found in four texts, are candidates of each other, but far below the least similarity."""
    draw = random.Random(7)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passages = [" ".join(words(60)) for _ in range(80)] * 4
    draw.shuffle(passages)
    texts = [" ".join(passages[i : i + 4]) for i in range(0, len(passages), 4)]
    base = words(300)
    texts += [" ".join(base), " ".join([*base[:60], "changed", *base[61:180], "too", *base[181:]])]
    made, sets = set(), near_copies._sets

    def counted(*args):
        out = sets(*args)
        made.update(r.node for r in out.select("node").collect())
        return out

    monkeypatch.setattr(near_copies, "_sets", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = {r.doc_id: r.root for r in near_copies.grouped(docs).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(roots[i], i)
    assert [least[roots[i]] for i in range(len(texts))] == brute(texts)
    assert {near_copies.node_of(x.encode()) for x in texts[-2:]} <= made
    assert len(made) <= 8
