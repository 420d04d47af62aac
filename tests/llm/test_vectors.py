import numpy as np
import pytest

from corvane.llm import vectors


def brute(rows, least=0.98):
    """{vec_id: (n_links, component_id)} by comparing all pairs."""
    ids = [r[0] for r in rows]
    ok = [x is not None and y is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, x, y in rows]
    unit = [np.array(x, dtype=np.float64) / np.linalg.norm(np.array(x, dtype=np.float64)) if good else None for (_, x, _), good in zip(rows, ok, strict=True)]
    links = {i: {j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least} for i in range(len(rows))}
    root = list(ids)
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([root[i], *(root[j] for j in near)])
            if low < root[i]:
                root[i], changed = low, True
    return {ids[i]: (len(links[i]), root[i]) for i in range(len(rows))}


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("block", [2048, 40])
def test_clusters_match_brute_force(spark, block):
    draw = np.random.default_rng(1)
    rows = []
    for c in range(60):
        base = draw.standard_normal(64)
        for _ in range([1, 3, 60][c % 3]):
            rows.append((len(rows) * 3 % 5000, (base + draw.standard_normal(64) * draw.choice([0.0, 0.05, 0.14, 0.2])).astype(np.float32).tolist(), int(c % 2)))
    rows = [(i, x, y) for i, (_, x, y) in enumerate(rows)]
    want = brute(rows)
    found = got(spark, rows, leaf=64, block=block)
    total, hit = sum(n for n, _ in want.values()), sum(n for n, _, _ in found.values())
    assert hit <= total and hit >= 0.999 * total
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(found[i][2] == (i == found[i][1]) for i in found)


def test_driver_rows_match_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, found = brute(rows), got(spark, rows)
    assert {i: x[:2] for i, x in found.items()} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_of_a_sample_far_below_the_rows(spark, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(1500):
        base = draw.standard_normal(64)
        rows += [(len(rows) + j, (base + draw.standard_normal(64) * draw.choice([0.05, 0.1, 0.14])).astype(np.float32).tolist(), 1) for j in range(4)]
    units = np.array([x for _, x, _ in rows], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = (units @ units.T >= 0.98).sum(axis=1) - 1
    forest = vectors.Forest(list(units[::60]), len(units), 0.98, vectors.TREES, vectors.SPILL, 32)
    assert forest.trees[64][0].below.shape[0] >= 3
    sizes = np.bincount(np.concatenate(forest.leaves(list(units))))
    assert sizes.max() < 600 and sizes[sizes > 0].mean() < 120
    found = got(spark, rows, fit_rows=100, leaf=32)
    n = np.array([found[i][0] for i in range(len(rows))])
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum()


def test_edge_cases(spark):
    one = [1.0] + [0.0] * 3
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, None, 1), (5, [0.0] * 4, 1), (6, [float("nan")] + one[1:], 1), (7, [None, 1.0, 0.0, 0.0], 1), (8, one, None), (9, [2.0, 0.0, 0.0, 0.0], 1), (10, [1.0], 1), (11, [], 1), (12, [3e38] * 4, 1), (13, [1e-40] * 4, 1)]
    found = got(spark, rows)
    assert {i: x[:2] for i, x in found.items()} == {1: (2, 1), 2: (2, 1), 9: (2, 1), 12: (1, 12), 13: (1, 12)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 10, 11)}
    df = spark.createDataFrame([(None, one, 1), (None, one, 1), (5, one, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()) == [(-1, 2, 5, False), (-1, 2, 5, False), (5, 2, 5, True)]
    assert vectors.near_duplicates(df.limit(0)).collect() == []
