"""Operators without SQL, against small models of their own."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import noise
from corvane.operators import chunking, ranking, retrieval
from corvane.sources import tables
from corvane.streaming import jobs


def greedy_mmr(rows, weight, penalty, k):
    left, out, seen = list(rows), [], set()
    while left and len(out) < k:
        best = max(left, key=lambda r: (round(weight * r[2] - (1 - weight) * penalty * (r[1] in seen and r[1] is not None), 9), -r[3]))
        left.remove(best)
        seen.add(best[1])
        out.append(best[0])
    return out


def test_mmr_windows_are_the_greedy_choice(spark):
    draw = random.Random(1)
    pools = {q: [(i, draw.choice([None, 1, 2, 3]), draw.choice([0.1, 0.5, 0.9, draw.random()]), i) for i in range(12)] for q in range(30)}
    df = spark.createDataFrame([(q, *r) for q, rows in pools.items() for r in rows], "query_id int, doc int, g int, score double, pos int")
    for weight in (0.0, 0.5, 0.7, 1.0):
        got = ranking.mmr(df, weight, {"g": 0.6}, 6).orderBy("rank").collect()
        for q, rows in pools.items():
            assert [r.doc for r in got if r.query_id == q] == greedy_mmr(rows, weight, 0.6, 6)


def test_collapsed_repeats(spark):
    lines = ["a line here"] * 4 + ["x"] * 5 + ["two of it", "two of it", "end"] + ["again and"] * 3
    got = spark.createDataFrame([(lines,)], "l array<string>").select(noise.collapsed_repeats(F.col("l"))).first()[0]
    assert got == ["a line here"] + ["x"] * 5 + ["two of it", "two of it", "end", "again and"]


def test_chunks_hold_their_bounds():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(200))
    chunks = chunking.packed(text)
    assert all(len(x) <= 1080 for x in chunks) and all(f"number {i} has" in " ".join(chunks) for i in range(200))
    assert chunking.packed("") == [] and chunking.packed(None) == [] and chunking.packed("y" * 5000) == ["y" * 5000]


def test_ranges_and_distances(spark):
    row = spark.createDataFrame([("$b3:AA1", "kitten", "sitting")], "r string, a string, b string").select(T.cell_range(F.col("r")).alias("r"), T.cer(F.col("b"), F.col("a")).alias("c"), T.cell_range(F.lit("nope")).alias("n")).first()
    assert tuple(row.r) == (1, 2, 3, 27) and row.n is None and row.c == 0.5


def test_filters(spark):
    docs = spark.createDataFrame([(1, "en", "a"), (2, "de", "a")], "doc_id int, lang string, source string")
    assert [r.doc_id for r in retrieval.allowed(docs, {"lang": "en", "source": "a"}).collect()] == [1]
    with pytest.raises(ValueError):
        retrieval.allowed(docs, {"colour": "red"})


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('# note\n{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    assert sorted(r.id for r in tables.lenient_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()) == [1, 2]
    assert sorted(r.id for r in tables.strict_jsonl(spark, str(tmp_path / "b.jsonl"), "id int, t string").collect()) == [1, 2]
    with pytest.raises(Exception, match="malformed line"):
        tables.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()
    (tmp_path / "c.csv").write_text("﻿id,t\n1,\"a,b\"\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_rows(spark, str(tmp_path / "c.csv")).collect()] == [("1", "a,b")]
    rows = spark.createDataFrame([(1, ["a", "b"], None)], "z int, l array<string>, n string")
    tables.write_csv_report(rows, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r.csv")).collect()] == [("a|b", None, "1")]
    tables.write_json_report(rows.agg(F.count("*").alias("n")), rows, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/summary")).first().n == 1


def moves(states):
    now, good, bad = "PENDING", 0, 0
    for s in states:
        if s in jobs.MOVES[now]:
            now, good = s, good + 1
        else:
            bad += 1
    return now, good, bad


def test_job_stream_equals_batch(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.randrange(6), i, draw.choice(list(jobs.MOVES))) for i in range(120)]
    want = {j: moves([s for k, _, s in rows if k == j]) for j in {r[0] for r in rows}}
    schema = "job_id long, seq long, state string"
    assert {r.job_id: (r.state, r.accepted, r.rejected) for r in jobs.replayed(spark.createDataFrame(rows, schema)).collect()} == want
    source = tmp_path / "in"
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.transitions(spark.readStream.schema(schema).parquet(str(source)), None)
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out{n}")).start()
        q.awaitTermination(120)
    last = {}
    for d in sorted(tmp_path.glob("out*")):
        last |= {r.job_id: (r.state, r.accepted, r.rejected) for r in spark.read.parquet(str(d)).collect()}
    assert last == want


def test_index_batches(spark, tmp_path):
    sink = jobs.index_batches(None, str(tmp_path), ["id"])
    sink(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0)
    for _ in range(2):  # the same batch may come again
        sink(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/v1").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_hashed_vectors(spark):
    from corvane.operators.embedding import embedded, hashed

    got = embedded(spark.createDataFrame([(1, "One two, one"), (2, ""), (3, None)], "doc_id int, text string"), 16).collect()
    assert {r.doc_id: list(r.vector) for r in got} == {1: hashed(["one", "two", "one"], 16), 2: [0.0] * 16, 3: [0.0] * 16}
    assert abs(sum(x * x for x in hashed(["one", "two", "one"], 16)) - 1) < 1e-9
