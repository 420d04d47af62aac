import random

import pytest

from corvane.llm import mixing


def filled(sizes, weights, cap):
    """Targets by the contract's own rounds: share out, stop at the cap, share the excess again."""
    target, free, left = {s: 0.0 for s in sizes}, set(sizes), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weights[s] for s in free)
        level = {s: left * weights[s] / total for s in free}
        over = {s for s in free if level[s] > cap * sizes[s]}
        if not over:
            for s in free:
                target[s] = level[s]
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def rows_of(seed):
    draw = random.Random(seed)
    rows = [(i, "w " * draw.randrange(0, 9), draw.choice(["b", "é", "a", "z", None, "a"])) for i in range(90)]
    return rows + [(1, rows[1][1], rows[1][2]), (None, "x y z", "b"), (200, None, "b"), (201, " \t", "only blank"), (202, "q " * 400, "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, s, "c", "d") for i, t, s in rows], "doc_id long, text string, source string, size string, SIZE string")
    got = mixing.assign(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and len(r.positions) == r.copies and r.taken == r.copies * r.size
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
    for s in sizes:
        longest = max([r.size for r in got if r.source == s])
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= longest / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.assign(docs.repartition(7)).collect()))


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w w w w", "abc"[i % 3]) for i in range(600)]
    copies = mixing.training_copies(mixing.assign(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert [r.position for r in copies] == sorted(r.position for r in copies)
    early = {s: sum(r.size for r in copies if r.source == s and r.position < 0.5) / sum(r.size for r in copies if r.source == s) for s in "abc"}
    for s, knots in zip("abc", mixing.CURRICULUM, strict=True):
        half = {0: 0.625, 1: 0.5, 2: 0.25}["abc".index(s)]
        assert early[s] == pytest.approx(half, abs=0.02), knots


def test_rows_of_one_id_keep_their_order(spark):
    rows = [(None, f"word{i % 7} b c", "ab"[i % 2]) for i in range(60)] + [(1, "x y", "a"), (1, "z q", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r.text, r.source, r.position) for r in mixing.training_copies(mixing.assign(d, keep=("text",))).collect()) for d in (docs, docs.repartition(5), docs.orderBy(docs.text.desc()))]
    assert runs[0] == runs[1] == runs[2]


def test_many_sources(spark):
    rows = [(i, "w " * (i % 5 + 1), f"host{i % 211:03d}") for i in range(900)]
    got = mixing.assign(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, 3)
    assert all(r.target == pytest.approx(want[r.source]) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.in_order(mixing.assign(docs)).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.taken, r.target, r.copies) for r in mixing.assign(blank).collect()} == {(0, 0.0, 0)}
