"""Top-k retrieval: exact k-nearest neighbours in blocks, tiered text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Query vectors of one pass over the corpus, which bounds what is broadcast.
SLAB = 16_384
#: Query vectors and rows that are multiplied at a time, which bounds what a task holds beside its batch.
TILE, ROWS = 512, 1024
#: Phrases of one pass over the documents.
PHRASES = 10_000


def ranked(rows: DataFrame, by: str | list[str], *order: Column | str, k: int | None = None) -> DataFrame:
    """Adds rank, from 1, within `by`; the first k of each."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int | None = None, same: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k greatest inner products for queries (query_id, vector) among vectors (doc_id, vector), a query itself left out.

    Queries are taken in slabs of bounded size; each task multiplies its rows with a slab and keeps a running top k for each query, so
    what is shuffled is k rows for each query and task.
    """
    spark = vectors.sparkSession
    n = queries.count()
    out = None
    for slab in range(max(1, -(-n // SLAB))):
        some = queries if n <= SLAB else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // SLAB))) == slab)
        rows = some.select("query_id", "vector").toArrow()
        ids = rows["query_id"].to_numpy()
        matrix = np.array(rows["vector"].to_pylist(), dtype=np.float64).reshape(len(ids), -1)[:, :dims]
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best, held = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
                docs = batch["doc_id"].to_numpy()
                if not len(docs) or not len(ids):
                    continue
                mine = np.asarray(batch["vector"].flatten(), dtype=np.float64).reshape(len(docs), -1)[:, :dims]
                for at in range(0, len(ids), TILE):
                    scores = np.round(matrix[at : at + TILE] @ mine.T, 6)
                    scores[ids[at : at + TILE][:, None] == docs[None, :]] = -np.inf
                    scores = np.hstack([best[at : at + TILE], scores])
                    names = np.hstack([held[at : at + TILE], np.broadcast_to(docs, (len(scores), len(docs)))])
                    if scores.shape[1] > 4 * k:  # all that may tie with the k-th stay for the sort
                        least = np.partition(scores, -k, axis=1)[:, -k, None]
                        width = int((scores >= least).sum(axis=1).max())
                        some = np.argpartition(scores, -width, axis=1)[:, -width:]
                        scores, names = np.take_along_axis(scores, some, axis=1), np.take_along_axis(names, some, axis=1)
                    order = np.lexsort((names, -scores), axis=1)[:, :k]
                    best[at : at + TILE], held[at : at + TILE] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)
            good = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[good]), pa.array(held[good]), pa.array(best[good])], ["query_id", "doc_id", "score"])

        part = vectors.select("doc_id", "vector").mapInArrow(run, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, "query_id", F.desc("score"), "doc_id", k=k)


def lexical_tiers(docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The first documents of `lexical_matches` for each query, with their rank."""
    return ranked(lexical_matches(docs, queries), "query_id", "tier", "doc_id", k=limit)


def lexical_matches(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, tier: documents that have the phrase (tier 0 at the start, 1 elsewhere), then all of its terms (tier 2).

    Terms are looked for within words, so no index of words finds them: a stated set of queries meets all rows in blocks of `PHRASES`
    queries, which bounds what is broadcast.
    """
    terms = F.array_distinct(F.filter(T.tokens(F.col("query")), lambda x: F.length(x) >= 2))
    asked = queries.select("query_id", F.lower("text").alias("query")).withColumn("terms", terms)
    own = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    blocks = max(1, -(-queries.count() // PHRASES))
    out = None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        joined = own.join(F.broadcast(some), F.forall("terms", lambda t: F.contains(F.col("text"), t)))
        tier = F.when(F.col("text").startswith(F.col("query")), 0).when(F.contains("text", F.col("query")), 1).otherwise(2)
        part = joined.select("query_id", "doc_id", tier.alias("tier"))
        out = part if out is None else out.unionByName(part)
    return out


def allowed(docs: DataFrame, filters: dict[str, str], known: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id of documents that fit all filters; an unknown filter is an error, no filter allows all."""
    if unknown := set(filters) - set(known):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for key, value in filters.items():
        docs = docs.where(F.col(key) == value)
    return docs.select("doc_id")
