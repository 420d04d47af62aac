import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corvane.llm import repeats


def test_answers_of_a_part_are_made_once(tmp_path):
    made = []
    for part in (1, 2):
        (tmp_path / f"part={part}").mkdir()
        pq.write_table(pa.table({"text": [part], "did": [5]}), tmp_path / f"part={part}" / "a.parquet")
    answers = repeats.Answers(f"file://{tmp_path}", ["text"], lambda x: made.append(x and x["text"].to_pylist()) or len(made))
    assert [answers.of(p) for p in (1, 1, 1, 2, 2, 3, 3)] == [1, 1, 1, 2, 2, 3, 3]
    assert made == [[1], [2], None]


def test_places_by_text():
    draw = random.Random(3)
    want, bodies = {}, []
    for _ in range(9):
        own = {t: [draw.randrange(1000) for _ in range(draw.randrange(1, 5))] for t in draw.sample(range(-10, 10), draw.randrange(1, 12))}
        for t in sorted(own):
            want.setdefault(t, []).extend(own[t])
        bodies.append(repeats._packed([np.array(sorted(own), "<i8"), np.array([len(own[t]) for t in sorted(own)], "<u4"), np.array([x for t in sorted(own) for x in own[t]], "<u4")]))
    known, ends, places = repeats._by_text(pa.table({"body": pa.array(bodies, pa.binary())}))
    assert known.tolist() == sorted(want)
    assert [x.tolist() for x in np.split(places, ends[:-1])] == [want[t] for t in sorted(want)]
    assert repeats._by_text(None) is None


def test_rows_of_a_part_in_many_batches(spark, tmp_path):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    shared = [text(90) for _ in range(40)]
    rows = [(i, text(10) + shared[i % 40] + text(10)) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = repeats.removed(spark.read.parquet(f"{tmp_path}/documents.parquet"), scan=True).select("doc_id", "n_removed", "n_spans").collect()
    assert all(r.n_removed == 0 for r in found if r.doc_id < 40)
    assert len(found) == 4000 and all(r.n_removed >= 90 and r.n_spans == 1 for r in found if r.doc_id >= 40)
