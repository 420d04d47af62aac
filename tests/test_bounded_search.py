"""What a task of a search holds at once does not grow with its batch and its queries' postings."""

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import lexical, retrieval


def searched(monkeypatch, postings):
    draw = np.random.default_rng(5)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    most = []
    opened = lexical.Searcher._open

    def spy(self, own, low, entry, query, weight, size, which):
        most.append(int(size.sum()))
        return opened(self, own, low, entry, query, weight, size, which)

    monkeypatch.setattr(lexical.Searcher, "_open", spy)
    query = np.repeat(np.arange(300), 6)
    search = lexical.Searcher(query, draw.integers(0, 40, len(query)), draw.random(len(query)), 300, 30.0, 7)
    for n in range(3):
        lengths = draw.integers(1, 60, 400)
        search.segment(lexical._segment(np.arange(400) + 400 * n, lengths, np.repeat(np.arange(400), lengths), draw.integers(0, 40, lengths.sum())))
    monkeypatch.setattr(lexical.Searcher, "_open", opened)
    return search.best, max(most)


def test_steps_by_postings_give_the_same_rows(monkeypatch):
    whole, all_at_once = searched(monkeypatch, 1 << 40)
    parts, most = searched(monkeypatch, 3000)
    assert most <= 3000 < all_at_once
    for x in ("query", "doc", "score", "floor"):
        assert np.array_equal(getattr(whole, x), getattr(parts, x)), x


def test_rows_by_tiles_give_the_same_rows(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") % 90 * i).cast("float")).alias("vector")).coalesce(2)
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    whole = sorted(map(tuple, retrieval.knn_topk(rows, asked, 6).collect()))
    monkeypatch.setattr(retrieval, "ROWS", 7)
    monkeypatch.setattr(retrieval, "TILE", 3)
    assert sorted(map(tuple, retrieval.knn_topk(rows, asked, 6).collect())) == whole and len(whole) == 25 * 6


def test_batches_of_texts_are_no_larger_than_segments(spark, monkeypatch):
    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], lexical.scratch.written
    before = spark.conf.get(name)
    monkeypatch.setattr(lexical.scratch, "written", lambda df: (seen.append(spark.conf.get(name)), written(df))[1])
    docs = spark.range(250).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    assert lexical.bm25_topk(docs, spark.range(1).select(F.col("id").alias("query_id"), F.lit("b").alias("text")), 3, size=100).count() == 3
    assert "100" in seen and spark.conf.get(name) == before
