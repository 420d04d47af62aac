"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by distance.

Fitting takes a bounded sample of labelled rows, `fit_rows` at most, drawn by a hash of the id. Terms are lower-cased words and
their beginnings of 5 characters; the index has every term of the sample. A term weighs (1 + log tf) * idf, with document frequencies
over all documents, times sqrt(1 + G2), G2 its association with the label in the sample (supervised term weighting): made-up and rare
words would fill a plain TF-IDF cosine, which tells the label less well (figures in the README). The cosine of these vectors is exact.

The index posts each term's weights in blocks of examples, with each block's maximum. A query's bound on a block is the sum of
its weights times those maxima; blocks are taken by falling bound, and those whose bound is under the k-th best cosine so far
are passed by, so that the k nearest are exact. Their votes, weighted by 1 / (1.05 - cosine) and drawn to the base rate, go
through a logistic curve fitted to the sample's own votes with each example left out.

Defined results: a text that is null, empty or without an indexed term has the calibrated base rate. Rows with null labels, or
whose id is null, are not learned from; an id labelled twice has the higher label. Without labels the score is 0.5 less a hair.
Repeated rows have equal results. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

FIT_ROWS, NEIGHBOURS, BLOCK, DENSE, QUERIES, BEGINNING = 4000, 10, 64, 16, 32, 5
WORDS = re.compile(r"\w+")


def terms_of(word: str) -> tuple[str, ...]:
    return (word, word[:BEGINNING] + "*") if len(word) > BEGINNING else (word,)


def term_counts(text: str) -> Counter[str]:
    out: Counter[str] = Counter()
    for word, n in Counter(WORDS.findall(text.lower())).items():
        for term in terms_of(word):
            out[term] += n
    return out


class Terms:
    """Places of the sample's terms, words and beginnings apart."""

    def __init__(self, terms: list[str]) -> None:
        self.words = {x: i for i, x in enumerate(terms) if x[-1] != "*"}
        self.begun = {x[:-1]: i for i, x in enumerate(terms) if x[-1] == "*"}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sample's terms in a whole text, in order, and their counts."""
        found = Counter(WORDS.findall(text.lower()))
        words, begun = self.words.get, self.begun.get
        at = np.array([words(x, -1) for x in found] + [begun(x[:BEGINNING], -1) if len(x) > BEGINNING else -1 for x in found], np.int64)
        n = np.tile(np.fromiter(found.values(), np.float64, len(found)), 2)
        at, of = np.unique(at, return_inverse=True)
        counts = np.bincount(of, n, len(at))
        return (at[1:], counts[1:]) if len(at) and at[0] < 0 else (at, counts)


def held_out(column: str = "doc_id") -> F.Column:
    """Every fifth id by checksum, and null ids, which nothing is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def examples_of(labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, toxic of the sample, at most `fit_rows` rows."""
    own = common.pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def vocabulary(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the sample (text, toxic) in order, and each one's association with the label (G2)."""
    def step(batch: dict) -> dict:
        df, positive = Counter(), Counter()
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            found = term_counts(text.as_py()).keys()
            df.update(found)
            if toxic.as_py():
                positive.update(found)
        return {"term": list(df), "n": list(df.values()), "p": [positive[x] for x in df]}

    whole = sample.agg(F.count("*").alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("positive")).first()
    rows, positive = float(whole["rows"]), float(whole["positive"])
    # The sample's terms are bounded by its rows.
    found = common.per_batch(sample, step, "term string, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow().sort_by("term")
    n, p = found["n"].to_numpy().astype(np.float64), found["p"].to_numpy().astype(np.float64)
    return found["term"].to_pylist(), association(n, p, rows, positive)


def association(n: np.ndarray, p: np.ndarray, rows: float, positive: float) -> np.ndarray:
    """G2 of terms in n of all rows and p of the positive ones."""
    def part(seen: np.ndarray, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen * rows / (a * b)), 0.0)

    g2 = 2 * (part(p, n, positive) + part(n - p, n, rows - positive) + part(positive - p, rows - n, positive) + part(rows - positive - n + p, rows - n, rows - positive))
    return np.maximum(np.nan_to_num(g2), 0.0)


VECTORS = "doc_id long, digest binary, steps binary, counts binary"


def vectors(docs: DataFrame, terms) -> DataFrame:
    """doc_id, digest, and as packed numbers the steps between the places of the text's terms, and their counts; written once."""
    def step(batch: dict) -> dict:
        found = [batch[""].counts(x.as_py()) for x in batch["text"]]
        return {"doc_id": batch["doc_id"], "digest": batch["digest"], "steps": pa.array([np.diff(x, prepend=0).astype("<u4").tobytes() for x, _ in found], pa.binary()), "counts": pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())}

    own = docs.withColumn("digest", common.digest_of(F.col("text")))
    return docs.sparkSession.read.parquet(common.stored(common.per_batch(own, step, VECTORS, lambda: Terms(terms.value), 2000)))


def unpacked(batch: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(np.frombuffer(x.as_py(), "<u4"), dtype=np.int64), np.frombuffer(n.as_py(), "<u4").astype(np.float64)) for x, n in zip(batch["steps"], batch["counts"], strict=True)]


def frequencies(vecs: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all documents; a task sends its sums once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for at, _ in unpacked({"steps": batch["steps"], "counts": batch["counts"]}):
                df[at] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], ["term", "n"])

    found = vecs.select("steps", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms + 1)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(df[-1]), df[:-1]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of n each, one after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


class Index:
    """Block-max postings of the examples' unit vectors, and the curve that calibrates their votes.

    Examples stand in blocks of `BLOCK`. A term in fewer than one of `DENSE` examples has a list of postings (`place`, `weight`, from `first` on);
    a more frequent one has the weights of each block side by side (`dense`) and each block's greatest (`most`). Lists are summed first, which
    gives each example a least cosine; a block can do no better than its best example with the frequent terms' maxima. Queries come some at a
    time, and a block takes those that it is live for in one product.
    """

    def __init__(self, vecs: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], ids: list[int], factor: np.ndarray) -> None:
        self.factor = factor
        units = [self.unit(*x) for x in vecs]
        dominant = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in units]
        order = sorted(range(len(vecs)), key=lambda i: (dominant[i], ids[i]))
        units = [units[i] for i in order]
        self.toxic, self.ids = np.array([toxic[i] for i in order], dtype=np.float64), np.array([ids[i] for i in order], dtype=np.int64)
        n = len(order)
        self.base = (self.toxic.sum() + 0.98) / (n + 2)
        self.blocks = -(-max(n, 1) // BLOCK)
        term = np.concatenate([np.empty(0, np.int64), *(at for at, _ in units)])
        place = np.repeat(np.arange(n), [len(at) for at, _ in units])
        weight = np.concatenate([np.empty(0), *(w for _, w in units)])
        frequent = np.bincount(term, minlength=len(factor)) * DENSE > n
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.dense = np.zeros((int(frequent.sum()), self.blocks, BLOCK))
        many = frequent[term]
        self.dense[self.row[term[many]], place[many] // BLOCK, place[many] % BLOCK] = weight[many]
        self.most = self.dense.max(axis=2)
        by = np.lexsort((place[~many], term[~many]))
        self.place, self.weight = place[~many][by].astype(np.int32), weight[~many][by]
        self.first = np.searchsorted(term[~many][by], np.arange(len(factor) + 1)).astype(np.int32)
        self.slope, self.shift = 1.0, 0.0
        self._calibrate(units)

    def unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.factor[at]
        norm = np.sqrt((weights * weights).sum())
        return (at, weights / norm) if norm > 0 else (at[:0], weights[:0])

    def nearest(self, units: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of some queries, places and cosines of its k nearest with a positive cosine, by falling cosine, then place."""
        count, width = len(units), self.blocks * BLOCK
        of = np.repeat(np.arange(count), [len(at) for at, _ in units])
        at, weights = np.concatenate([np.empty(0, np.int64), *(x for x, _ in units)]), np.concatenate([np.empty(0), *(w for _, w in units)])
        first, row = self.first[at], self.row[at]
        n = self.first[at + 1] - first
        posts = _ranges(first, n)
        cosines = np.bincount(self.place[posts] + np.repeat(of * width, n), np.repeat(weights, n) * self.weight[posts], count * width).astype(np.float64).reshape(count, width)
        if without is not None:
            cosines[np.arange(count), without] = -np.inf
        heavy = np.zeros((count, len(self.dense)))
        heavy[of[row >= 0], row[row >= 0]] = weights[row >= 0]
        parts = cosines.reshape(count, self.blocks, BLOCK)
        bounds = parts.max(axis=2) + heavy @ self.most
        live = bounds >= -np.partition(-bounds, min(8, self.blocks) - 1, axis=1)[:, min(8, self.blocks) - 1, None]
        done = np.zeros_like(live)
        while live.any():
            for b in np.flatnonzero(live.any(axis=0)).tolist():
                mine = np.flatnonzero(live[:, b])
                parts[mine, b] += heavy[mine] @ self.dense[:, b]
            done |= live
            least = np.partition(cosines, -k, axis=1)[:, -k] if width > k else np.full(count, -np.inf)
            live = ~done & (bounds + 1e-9 >= least[:, None]) & (bounds > 0)
        out = []
        for own in cosines:
            near = np.flatnonzero(own >= max(np.partition(own, -k)[-k] - 1e-11, 1e-12)) if width > k else np.flatnonzero(own > 1e-12)
            top = near[np.lexsort((near, -np.round(own[near], 12)))][:k]
            out.append((top, own[top]))
        return out

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = 1 / (1.05 - np.minimum(cosines, 1.0))
        return float(((weights * self.toxic[places]).sum() + 2 * self.base) / (weights.sum() + 2))

    def _calibrate(self, units: list, k: int = NEIGHBOURS) -> None:
        """Logistic regression of the label on the vote's log odds, with each example left out; kept plain where a class has under ten."""
        y = self.toxic
        if min(y.sum(), len(y) - y.sum()) < 10:
            return
        v = np.array([self.vote(*x) for at in range(0, len(units), QUERIES) for x in self.nearest(units[at : at + QUERIES], k, list(range(at, min(at + QUERIES, len(units)))))])
        x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], axis=1)
        b = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ b))
            hessian = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-3 * np.eye(2)
            b = b + np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * (b - [1.0, 0.0]))
        self.slope, self.shift = float(np.clip(b[0], 0.1, 10)), float(b[1])

    def scores(self, vecs: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, ids and cosines of the nearest examples of each text."""
        out = []
        for at in range(0, len(vecs), QUERIES):
            for places, cosines in self.nearest([self.unit(*x) for x in vecs[at : at + QUERIES]], k):
                v = self.vote(places, cosines)
                out.append((float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))), self.ids[places], cosines))
        return out


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], Index, DataFrame]:
    """The sample's terms, the index of its examples, and the vectors of all documents."""
    spark = docs.sparkSession
    sample = common.cut(examples_of(labels, fit_rows))
    own = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample has at most fit_rows rows of two numbers, which bounds what is broadcast; its vectors come to the driver.
    known = common.cut(own.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    terms, g2 = vocabulary(known.select("text", "toxic"))
    vecs = vectors(own, spark.sparkContext.broadcast(terms))
    n, df = frequencies(vecs, len(terms))
    known = known.withColumn("digest", common.digest_of(F.col("text"))).select("doc_id", "digest", "toxic")
    examples = vecs.join(F.broadcast(known), ["doc_id", "digest"]).dropDuplicates(["doc_id"]).toArrow()
    factor = np.maximum(np.log((n + 1) / (df + 0.5)), 0.0) * np.sqrt(1 + g2)
    return terms, Index(unpacked(examples), examples["toxic"].to_pylist(), examples["doc_id"].to_pylist(), factor), vecs


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted, as evidence the ids and cosines of the nearest examples, and a digest that tells the texts of an id apart."""
    _, index, vecs = fitted(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def step(batch: dict) -> dict:
        found = batch[""].scores(unpacked(batch), neighbours)
        ends = np.cumsum([0, *(len(x[1]) for x in found)])
        join = lambda i, kind: np.concatenate([np.empty(0, kind), *(x[i] for x in found)])
        return {"doc_id": batch["doc_id"], "digest": batch["digest"], "score": [x[0] for x in found], "evidence": common.lists(ends, join(1, np.int64)), "cosines": common.lists(ends, join(2, np.float64))}

    out = common.per_batch(vecs, step, "doc_id long, digest binary, score double, evidence array<long>, cosines array<double>", lambda: shared.value, 2000)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence", "cosines", "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("digest")
