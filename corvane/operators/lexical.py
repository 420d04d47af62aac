"""BM25 over segments of postings with block maxima.

Documents are tokenised once, where they are read, and written as segments: the postings of a few thousand documents, term by term, in
blocks of neighbouring documents, each with the greatest count and the least length of its postings. Nothing is shuffled by term, so a
frequent term is no hot key. To search, each task keeps the k best of every query; a segment's block maxima bound what a query can score in
each block, and only blocks whose bound reaches the query's k-th score are opened, the best ones first.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import match as M
from corvane.operators.retrieval import ranked
from corvane.sources import scratch

#: Fixed parameters of BM25.
K1, B = 1.5, 0.75
#: Documents of a segment and of a block in it, queries of one pass over the segments and of one step of it, postings of a step beyond its first query.
SEGMENT, BLOCK, SLAB, STEP, POSTINGS = 4096, 8, 4096, 256, 1 << 20
#: So many different terms of queries are sent to the tasks that make segments, which then keep no others; beyond, segments have all terms.
TERMS = 1_000_000
LAYOUT = "ids array<bigint>, lengths array<int>, total bigint, terms array<bigint>, counts array<int>, firsts array<int>, blocks array<int>, peaks array<int>, shortest array<int>, starts array<int>, docs array<int>, tfs array<int>"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.logical_or.reduce([np.append(True, x[1:] != x[:-1]) for x in keys]))


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of ranges of n from their starts, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n)


def _segment(ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray) -> dict:
    """A row of LAYOUT from the documents' ids and lengths, and each token's document and term."""
    order = np.lexsort((doc, term))
    doc, term = doc[order], term[order]
    at = _runs(term, doc)
    tf = np.diff(np.append(at, len(term)))
    doc, term = doc[at], term[at]
    block = doc // BLOCK
    entry = _runs(term, block)
    first = _runs(term[entry])
    empty = len(doc) == 0
    return {
        "ids": ids, "lengths": lengths, "total": int(lengths.sum()), "terms": term[entry][first], "counts": np.diff(np.append(_runs(term), len(term))),
        "firsts": first, "blocks": block[entry], "peaks": tf if empty else np.maximum.reduceat(tf, entry),
        "shortest": doc if empty else np.minimum.reduceat(lengths[doc], entry), "starts": entry, "docs": doc, "tfs": tf,
    }


def segments(docs: DataFrame, wanted: np.ndarray | None = None, size: int = SEGMENT) -> DataFrame:
    """LAYOUT rows of docs (doc_id, text), with the terms whose hashes are in `wanted` (sorted), or all. Terms are named by 64 bits."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    kinds = [("bigint", pa.list_(pa.int64())), ("int", pa.list_(pa.int32()))]
    schema = pa.schema([(x.split(" ")[0], pa.int64() if x.endswith(" bigint") else next(kind for name, kind in kinds if x.endswith(f"<{name}>"))) for x in LAYOUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for whole in batches:
            for batch in (whole.slice(i, size) for i in range(0, whole.num_rows, size)):
                tokens = batch["terms"]
                lengths = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                term, doc = tokens.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
                if wanted is not None:
                    at = np.searchsorted(wanted, term)
                    kept = wanted[np.minimum(at, len(wanted) - 1)] == term if len(wanted) else np.zeros(len(term), bool)
                    term, doc = term[kept], doc[kept]
                row = _segment(batch["doc_id"].to_numpy(), lengths, doc, term)
                yield pa.RecordBatch.from_pylist([row], schema)

    hashed = F.transform(M.bm25_tokens(F.col("text")), lambda x: F.xxhash64(x))
    return docs.select(F.col("doc_id").cast("long"), hashed.alias("terms")).mapInArrow(run, LAYOUT)


@contextlib.contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of `rows` rows at most for what is run inside, as two workers of a task hold the texts and tokens of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Best:
    """The k best documents of each query so far, equal scores by the lesser id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.doc, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.floor[query]
        if not good.any():
            return
        query, doc, score = query[good], doc[good], score[good]
        own = slice(*np.searchsorted(self.query, [query.min(), query.max() + 1]))  # what is held is in order of queries
        query, doc, score = (np.concatenate(x) for x in ((self.query[own], query), (self.doc[own], doc), (self.score[own], score)))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        start = _runs(query)
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        held = place < self.k
        self.query, self.doc, self.score = (np.concatenate([x[: own.start], y[held], x[own.stop :]]) for x, y in ((self.query, query), (self.doc, doc), (self.score, score)))
        full = place == self.k - 1
        self.floor[query[full]] = score[full]


class Searcher:
    """Queries (terms and weights, query by query) over one segment after another."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, mean: float, k: int) -> None:
        self.query, self.term, self.weight, self.queries, self.mean = query, term, weight, queries, mean
        self.best = Best(queries, k)
        self.visited = self.total = 0

    def segment(self, row: dict) -> None:
        own = {k: np.asarray(v) for k, v in row.items() if k != "total"}
        terms = own["terms"]
        if not len(terms):
            return
        blocks = -(-len(own["ids"]) // BLOCK)
        ends = np.append(own["firsts"][1:], len(own["starts"]))
        last = np.append(own["starts"][1:], len(own["docs"]))
        bound = impact(own["peaks"].astype(float), own["shortest"], self.mean)
        at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
        found = np.flatnonzero(terms[at] == self.term)
        for low, high in self._steps(self.query[found], own["starts"], own["firsts"], ends, last, at[found]):
            some = found[slice(*np.searchsorted(self.query[found], [low, high]))]
            if not len(some):
                continue
            n = ends[at[some]] - own["firsts"][at[some]]
            entry, of = _spread(own["firsts"][at[some]], n), np.repeat(some, n)
            query, weight = self.query[of] - low, self.weight[of]
            size = last[entry] - own["starts"][entry]
            self.total += int(size.sum())
            cell = query * blocks + own["blocks"][entry]
            most = np.bincount(cell, weight * bound[entry], STEP * blocks).reshape(STEP, blocks)
            floor = self.best.floor[low:high]
            floor = np.append(floor, np.full(STEP - len(floor), np.inf))
            # The best blocks of each query first, as they raise the score that the others have to reach.
            ahead = np.zeros(most.shape, bool)
            first = min(blocks, max(4, 2 * self.best.k // BLOCK))
            np.put_along_axis(ahead, np.argpartition(-most, first - 1, axis=1)[:, :first], True, axis=1)
            ahead &= (most > 0) & (most + 1e-6 >= floor[:, None])
            self._open(own, low, entry, query, weight, size, ahead.ravel()[cell])
            floor = self.best.floor[low:high]
            floor = np.append(floor, np.full(STEP - len(floor), np.inf))
            rest = ~ahead & (most > 0) & (most + 1e-6 >= floor[:, None])
            self._open(own, low, entry, query, weight, size, rest.ravel()[cell])

    def _steps(self, query: np.ndarray, starts: np.ndarray, firsts: np.ndarray, ends: np.ndarray, last: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of up to STEP queries with some POSTINGS in all, as what a step holds grows with both; a query of more is a step of its own."""
        size = np.cumsum(np.bincount(query, last[ends[at] - 1] - starts[firsts[at]], self.queries))
        low = 0
        while low < self.queries:
            most = (size[low - 1] if low else 0) + POSTINGS
            high = min(low + STEP, max(low + 1, int(np.searchsorted(size, most, side="right"))), self.queries)
            yield low, high
            low = high

    def _open(self, own: dict, low: int, entry: np.ndarray, query: np.ndarray, weight: np.ndarray, size: np.ndarray, which: np.ndarray) -> None:
        """Scores the documents of these entries' blocks."""
        if not which.any():
            return
        entry, size = entry[which], size[which]
        place = _spread(own["starts"][entry], size)
        self.visited += len(place)
        doc = own["docs"][place]
        part = np.repeat(weight[which], size) * impact(own["tfs"][place].astype(float), own["lengths"][doc], self.mean)
        cell = np.repeat(query[which], size) * len(own["ids"]) + doc
        score = np.bincount(cell, part, STEP * len(own["ids"]))
        met = np.flatnonzero(score)
        self.best.add(met // len(own["ids"]) + low, own["ids"][met % len(own["ids"])], np.round(score[met], 6))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, size: int = SEGMENT, visits: tuple[Accumulator, Accumulator] | None = None, terms: int = TERMS) -> DataFrame:
    """query_id, doc_id, score, rank of docs (doc_id, text) for queries (query_id, text).

    A query's repeated terms count as often; a query without known terms has no rows, a null text no tokens. `visits` counts the postings scored, and those that a search
    without bounds would score.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.explode(M.bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", F.xxhash64("term").alias("term")).agg(F.count("*").alias("times"))
    asked = scratch.written(asked)
    names = asked.select("term").distinct()
    few = names.limit(terms + 1).count() <= terms
    terms_of = np.sort(names.toArrow()["term"].to_numpy()) if few else None
    with _batches(spark, size):
        own = scratch.written(segments(docs, terms_of, size))
    sums = own.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.sum("total").alias("total")).first()
    mean = float(max(sums["total"] or 0, 1) / max(sums["n"], 1))
    df = own.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    idf = F.log(1 + (F.lit(sums["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = scratch.written(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")))
    slabs = max(1, -(-weights.select("query_id").distinct().count() // SLAB))
    out = None
    for slab in range(slabs):
        rows = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(slabs)) == slab).orderBy("query_id").toArrow()
        ids, query = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        shared = spark.sparkContext.broadcast((ids, query, rows["term"].to_numpy(), rows["weight"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, query, term, weight = shared.value
            search = Searcher(query, term, weight, len(ids), mean, k)
            for batch in batches:
                for i in range(batch.num_rows):
                    search.segment({name: column[i].values.to_numpy() if name != "total" else 0 for name, column in zip(batch.schema.names, batch.columns, strict=True)})
            if visits:
                visits[0].add(search.visited)
                visits[1].add(search.total)
            best = search.best
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.doc), pa.array(best.score)], ["query_id", "doc_id", "score"])

        part = own.mapInArrow(run, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, "query_id", F.desc("score"), "doc_id", k=k)
