import random

import pytest

from corvane.llm import near_copies
from corvane.llm.components import components


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(99, i) for i in range(60)] + [(99, 99)], [(3, 3)], [(1, 2), (4, 3), (None, 5), (2, 1)]])
def test_closed_at_once_as_by_rounds(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    rounds = sorted(map(tuple, components(df).collect()))
    assert sorted(map(tuple, components(df, whole=len(edges)).collect())) == rounds
    assert sorted(map(tuple, components(df, whole=1).collect())) == rounds  # more edges than that go by rounds


def test_near_copies_of_a_small_table_take_few_jobs(spark):
    draw = random.Random(4)
    texts = []
    for _ in range(20):
        base = [f"w{draw.randrange(3000)}" for _ in range(300)]
        texts += [" ".join([*base[:i], f"x{i}", *base[i:]]) for i in range(0, 300, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    kept, n = jobs(spark, "near copies", lambda: sorted(r.doc_id for r in near_copies.representatives(docs).collect()))
    print("jobs", n)
    assert kept == list(range(0, 200, 10))
    assert n <= 100  # 82; with rounds 145
