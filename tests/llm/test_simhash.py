import random

import numpy as np
import pytest
import xxhash

from corvane.llm import simhash


def brute(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if len(parts) < words else [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def closure(fps):
    """Least index reachable by links, by comparing all pairs."""
    root = list(range(len(fps)))
    for _ in fps:
        new = [min(root[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 4) for x in fps]
        if new == root:
            break
        root = new
    return root


@pytest.mark.parametrize("limit", [simhash.LIMIT, 20])
def test_components_match_brute_force(spark, limit):
    draw = random.Random(5)
    fps = []
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(draw.choice([1, 5, 40])):
            x = base
            for i in draw.sample(range(64), draw.randrange(0, 7)):
                x ^= 1 << i
            fps.append(x)
    fps += fps[:5] + [0, 0, 1, 15, 0xFF00]
    rows = [(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)]
    found = {r.doc_id: r.component_id for r in simhash.components_of(spark.createDataFrame(rows, "doc_id long, fp long"), limit).collect()}
    assert [found[i] for i in range(len(fps))] == closure(fps)


def test_fingerprints_and_edge_cases(spark):
    texts = ["a b c d e f", "A  b\tC d e\x0bf", "one two", "", None, "  \n ", "ü é Ü x " * 500, "a b c d e f"]
    docs = spark.createDataFrame([(i, t, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, TEXT string, fp string")
    found = {r.doc_id: r.fp for r in simhash.fingerprints(docs, 4).collect()}
    assert {i: x % 2**64 for i, x in found.items()} == {i: brute(t) for i, t in enumerate(texts)}
    assert found[3] == found[4] == found[5] == 0 and found[0] == found[1] == found[7]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components_of(simhash.fingerprints(docs, 4)).collect() == []
