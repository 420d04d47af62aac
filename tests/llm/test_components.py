import random

import pytest

from corvane.llm.components import components


@pytest.mark.parametrize("kind", ["random", "chain", "star", "reverse star", "none"])
def test_least_reachable(spark, kind):
    draw = random.Random(6)
    edges = {
        "random": [(draw.randrange(80), draw.randrange(80)) for _ in range(60)],
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 60)],
        "reverse star": [(99, i) for i in range(60)] + [(99, 99)],
        "none": [(3, 3)],
    }[kind]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {x: r for x, r in least.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in components(df).collect()} == want
