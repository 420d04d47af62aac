"""Samples and selections that depend on what is already chosen, without a driver's loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.retrieval import SLAB
from corvane.sources import scratch


def reservoir(rows: DataFrame, k: int, key: str, seed: str) -> DataFrame:
    """A uniform sample of k rows: those of the least hash, a top-k that merges like a reservoir; the same for the same seed."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(k).drop("_h")


def whole_queries(rows: DataFrame, k: int, seed: str, query: str = "query_id") -> DataFrame:
    """All rows of k queries, drawn from the distinct ones."""
    return rows.join(reservoir(rows.select(query).distinct(), k, query, seed), query, "left_semi")


def balanced(rows: DataFrame, by: str, group: str, score: Column, quota: Column, step: float, key: str) -> DataFrame:
    """Of each `by` as many rows as its quota by the score less `step` for each row of the same group already taken.

    A row's value falls with its place in its group only, so taking the best again and again is ordering by score less steps before it.
    """
    place = F.row_number().over(Window.partitionBy(by, group).orderBy(F.desc("_s"), key))
    out = rows.withColumn("_s", F.round(score, 9)).withColumn("_v", F.round(F.col("_s") - step * (place - 1), 9))
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_v"), key))
    return out.withColumn("n", order).where(F.col("n") <= quota).drop("_s", "_v")


#: Fixed: kinds of question that rest on their evidence, and phrases of someone looking for a thing.
LINKED = ("character_question", "setting_question", "plot_memory", "theme_question", "comparison_like", "vague_recall")
ASKING = ("뭐였", "찾고 있어", "찾아줘")


def row_quality(query: Column, evidence: Column, kind: Column, shared: Column, copies_title: Column) -> Column:
    """How well a row is fit for a gold set, by the lengths of question and evidence, their shared words (which count less where the kind of question does not rest on evidence), and the kind of question."""
    query, evidence = F.trim(F.coalesce(query, F.lit(""))), F.trim(F.coalesce(evidence, F.lit("")))
    q, e = F.length(query), F.length(evidence)
    asked = F.when(q.between(24, 125), 8.0).when(q < 18, -18.0).when(q > 150, -12.0).otherwise(0.0)
    told = F.when(e.between(45, 220), 6.0).when(e < 35, -15.0).otherwise(0.0)
    words = F.when(kind.isin(*LINKED), F.least(shared, F.lit(5)) * 2.0).otherwise(F.least(shared, F.lit(3)) * 0.8)
    hard = F.when(kind.isin("wrong_assumption", "ambiguous", "unanswerable"), -4.0).otherwise(0.0)
    seeks = F.when(F.contains(query, F.lit(ASKING[0])) | F.contains(query, F.lit(ASKING[1])) | F.contains(query, F.lit(ASKING[2])), 2.0).otherwise(0.0)
    return F.round(100.0 + asked + told + words + F.when(copies_title, -18.0).otherwise(0.0) + hard + seeks, 9)


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """a, b (a before b) of rows (id, vector) whose cosine is at least `least`: a stated set against itself, in blocks of bounded size."""
    n = vectors.count()
    blocks = max(1, -(-n // SLAB))
    out = None
    for block in range(blocks):
        some = vectors if blocks == 1 else vectors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        rows = some.select("id", "vector").toArrow()
        ids, matrix = rows["id"].to_numpy(), np.array(rows["vector"].to_pylist(), dtype=np.float64).reshape(rows.num_rows, -1)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                mine = np.asarray(batch["vector"].flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                mine = mine / np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-300)
                i, j = np.nonzero(np.round(matrix @ mine.T, 9) >= least)
                a, b = ids[i], batch["id"].to_numpy()[j]
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a", "b"])

        part = vectors.select("id", "vector").mapInArrow(run, "a long, b long")
        out = part if out is None else out.unionByName(part)
    return out


def greedily_kept(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of the rows that stay when each, in order, goes if one before it that has stayed is similar (pairs a, b).

    In each round a row whose similar rows before it have all gone stays, and one with such a row that has stayed goes; the least open row
    is settled in every round.
    """
    state = scratch.written(ids.select("id", F.lit(None).cast("boolean").alias("stays")))
    pairs = scratch.written(pairs)
    while True:
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("stays").alias("s")), "a").groupBy("b").agg(F.bool_or(F.coalesce("s", F.lit(False))).alias("beaten"), F.bool_or(F.col("s").isNull()).alias("open"))
        settled = F.when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = scratch.written(state.join(before, state["id"] == before["b"], "left").select("id", F.coalesce("stays", settled).alias("stays")))
        if state.where(F.col("stays").isNull()).isEmpty():
            return state.where("stays").select("id")
