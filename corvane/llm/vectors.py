"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

A tree splits the sphere again and again: a random direction, the sample's median along it, and a margin on both sides of that
median within which a vector goes down both ways. Vectors of a leaf and a label are compared with each other, in double
precision; what is found is exact, and what the trees can miss is a pair that a split tears apart in every tree. The margin is
`spill` standard deviations of how far a pair at the threshold can differ along a direction: a split tears such a pair apart about once
in 75 times, a tree of 16 levels once in five, and all `trees` = 6 of them less than once in ten thousand.

Trees are fitted on a bounded sample, `fit_rows` distinct vectors at most, drawn by a hash of the vector; all vectors are indexed.
A leaf has some sample vectors at least; where all vectors would leave it more than `leaf` rows, it is split on below, in as many levels
as the rows ask for, by further random directions at the mean of its own sample vectors. So trees deepen with the data, and the
number of vectors to compare with one doesn't grow with it, but for copies.
Equal vectors of a label are one vector with a weight. A leaf of more than `block` vectors is dealt in blocks, and each pair of
blocks is a unit of its own, so no task holds more than two blocks and no pair is lost. Pairs aren't written out: a unit gives each vector's
number of links and the edges of a spanning forest. A pair that meets in several leaves counts in the first of them only, which
the leaf lists of the two tell.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and those with a null label, have no
links and are their own component. Vectors of different lengths don't link. A vec_id that stands more than once is one node of
its components; a null vec_id has a null component unless an equal or linked vector has an id. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.components import components, roots

LEAST, TREES, SPILL, FIT_ROWS, FEW, LEAF, BLOCK, SEED = 0.98, 6, 0.5, 20_000, 8, 256, 2048, 7


class Tree:
    """Nodes (direction, threshold, left, right), or of a leaf its first number, counted on from `first`, and its sample's mean.

    `deeper`: levels below a leaf, each with a direction of the whole tree's, which split it at its sample's mean along it.
    """

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, leaf: int, deeper: int, margin: float, first: int) -> None:
        self.nodes: list = []
        self.margin, self.last = margin, first
        below = rng.standard_normal((deeper, sample.shape[1]))
        self.below = below / np.linalg.norm(below, axis=1, keepdims=True)
        self._grow(sample, rng, leaf, 0)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, leaf: int, depth: int) -> int:
        place = len(self.nodes)
        self.nodes.append(None)
        if len(rows) > leaf and depth < 40:
            for _ in range(3):
                direction = rng.standard_normal(rows.shape[1])
                direction /= np.linalg.norm(direction)
                along = rows @ direction
                threshold = float(np.median(along))
                left, right = rows[along <= threshold], rows[along > threshold]
                if len(left) and len(right):
                    self.nodes[place] = (direction, threshold, self._grow(left, rng, leaf, depth + 1), self._grow(right, rng, leaf, depth + 1))
                    return place
        self.nodes[place] = (self.last, self.below @ rows.mean(axis=0))
        self.last += 1 << len(self.below)
        return place

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row comes to."""
        out, todo = [], [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if len(found := self.nodes[node]) == 2:
                number, means = found
                leaf, along = np.full(len(at), number), rows[at] @ self.below.T - means
                for i in range(len(self.below)):
                    low, high = along[:, i] <= self.margin, along[:, i] > -self.margin
                    at, leaf, along = (np.concatenate([x[low], x[high] + (1 << i if k == 1 else 0)]) for k, x in enumerate((at, leaf, along)))
                out.append((at, leaf))
            else:
                direction, threshold, left, right = found
                along = rows[at] @ direction
                todo += [(left, at[along <= threshold + self.margin]), (right, at[along > threshold - self.margin])]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


class Forest:
    """Trees for each vector length of the sample; vectors of other lengths share one leaf, number 0."""

    def __init__(self, sample: list[np.ndarray], rows: int, least: float, trees: int, spill: float, leaf: int) -> None:
        self.trees: dict[int, list[Tree]] = {}
        first = 1
        for dim in sorted({len(x) for x in sample}):
            own = np.array([x for x in sample if len(x) == dim])
            each = rows / len(sample)  # rows that a sample vector stands for
            share = max(FEW, int(leaf / each))
            deeper = max(0, int(np.ceil(np.log2(min(share, len(own)) * each / leaf)))) if len(own) > share or each > 1 else 0
            margin = spill * np.sqrt(max(0.0, 2 - 2 * least) / dim)
            rng = np.random.default_rng([SEED, dim])
            self.trees[dim] = []
            for _ in range(trees):
                self.trees[dim].append(Tree(own, rng, share, deeper, margin, first))
                first = self.trees[dim][-1].last

    def leaves(self, units: list[np.ndarray]) -> list[np.ndarray]:
        """Each vector's leaves in order."""
        out: list[np.ndarray] = [np.zeros(1, np.int64)] * len(units)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(units):
            by.setdefault(len(x), []).append(i)
        for dim, at in by.items():
            if dim in self.trees:
                rows = np.array([units[i] for i in at])
                found = [t.leaves(rows) for t in self.trees[dim]]
                row, leaf = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                order = np.lexsort((leaf, row))
                cuts = np.searchsorted(row[order], np.arange(1, len(at)))
                for i, x in zip(at, np.split(leaf[order].astype(np.int64), cuts), strict=True):
                    out[i] = x
        return out


def unit(vec: bytes) -> np.ndarray:
    x = np.frombuffer(vec, dtype="<f8")
    return x / np.sqrt((x * x).sum())


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, key (null for vectors that link with nothing), vec as doubles."""
    def step(batch: dict) -> dict:
        keys, vecs = [], []
        for x, label in zip(batch["embedding"], batch["label"], strict=True):
            x, key = x.values, None
            if label.is_valid and x is not None and len(x) and not x.null_count:
                v = np.asarray(x, dtype="<f8") + 0.0
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        v = v / 2.0 ** np.floor(np.log2(top))
                        key = xxhash.xxh3_128_digest(v.tobytes() + str(label.as_py()).encode())
            keys.append(key)
            vecs.append(v.tobytes() if key else None)
        return {"vec_id": batch["vec_id"], "label": batch["label"], "key": pa.array(keys, pa.binary()), "vec": pa.array(vecs, pa.binary())}

    own = common.pick(embeddings, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    return common.per_batch(own, step, "vec_id long, label string, key binary, vec binary")


def _placed(distinct: DataFrame, forest, blocks: int) -> DataFrame:
    """label, leaf, id, weight, vec, leaves: a row for each leaf that a vector comes to."""
    def step(batch: dict) -> dict:
        found = batch[""].leaves([unit(x) for x in batch["vec"].to_pylist()])
        n = np.array([len(x) for x in found])
        at = pa.array(np.repeat(np.arange(len(n)), n))
        lists = pa.array([x.tobytes() for x in found], pa.binary())
        return {k: batch[k].take(at) for k in ("label", "id", "weight", "vec")} | {"leaf": np.concatenate(found), "leaves": lists.take(at)}

    return common.per_batch(distinct.select("label", "id", "weight", "vec"), step, "label string, leaf long, id long, weight long, vec binary, leaves binary", lambda: forest.value)


def _units(placed: DataFrame, block: int) -> DataFrame:
    """Adds `b`, the vector's own block, and the pair of blocks (x, y) of each unit that it is in."""
    large = placed.groupBy("label", "leaf").count().where(F.col("count") > block).select("label", "leaf", F.ceil(F.col("count") / block).cast("int").alias("n"))
    large = common.cut(large)
    if large.isEmpty():
        return placed.withColumn("b", F.lit(0)).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    placed = placed.join(large, ["label", "leaf"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("vec"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return placed.withColumn("x", F.least("b", "j")).withColumn("y", F.greatest("b", "j")).drop("n", "j")


def compared(units: np.ndarray, sides: np.ndarray, alone: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) at or over the threshold: all of them, or those between the two blocks."""
    found = []
    for at in range(0, len(units), 512):
        i, j = np.nonzero(units[at : at + 512] @ units.T >= least)
        i += at
        good = (i < j) & (alone | (sides[i] != sides[j]))
        found.append((i[good], j[good]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def first_meeting(i: np.ndarray, j: np.ndarray, leaves: np.ndarray, leaf: int) -> np.ndarray:
    """Whether no earlier leaf holds both."""
    out = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 20_000):
        a, b = leaves[i[at : at + 20_000]], leaves[j[at : at + 20_000]]
        out[at : at + 20_000] = ~((a[:, :, None] == b[:, None, :]) & ((a >= 0) & (a < leaf))[:, :, None]).any(axis=(1, 2))
    return out


def _linked(rows: DataFrame, least: float) -> DataFrame:
    """id, n, root: links that count in the unit, and the unit's least linked id."""
    keys = ["label", "leaf", "x", "y"]

    def of(group: pa.Table) -> pa.RecordBatch | None:
        vecs = group["vec"].to_pylist()
        if len(vecs) < 2 or len({len(x) for x in vecs}) > 1:
            return None
        own = np.array([unit(x) for x in vecs])
        ids, weight, sides = (np.asarray(group[x]) for x in ("id", "weight", "b"))
        leaf, alone = group["leaf"][0].as_py(), group["x"][0] == group["y"][0]
        i, j = compared(own, sides, alone, least)
        if not len(i):
            return None
        lists = [np.frombuffer(x, dtype=np.int64) for x in group["leaves"].to_pylist()]
        leaves = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for k, x in enumerate(lists):
            leaves[k, : len(x)] = x
        counts = first_meeting(i, j, leaves, leaf)
        n = np.bincount(i[counts], weight[j[counts]], len(own)) + np.bincount(j[counts], weight[i[counts]], len(own))
        nodes, root = roots(i, j)
        order = np.argsort(ids[nodes], kind="stable")
        low = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(low, root[order], ids[nodes[order]])
        return pa.RecordBatch.from_arrays([pa.array(ids[nodes]), pa.array(n[nodes].astype(np.int64)), pa.array(low[root])], ["id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            cuts = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]]
            for start, end in zip(cuts, [*cuts[1:], len(marks)], strict=True):
                if marks[start] != last and held:
                    if (out := of(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield out
                    held = []
                last = marks[start]
                held.append(batch.slice(start, end - start))
        if held and (out := of(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, n long, root long")


def near_duplicates(embeddings: DataFrame, least: float = LEAST, trees: int = TREES, spill: float = SPILL, fit_rows: int = FIT_ROWS, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = common.cut(prepared(embeddings))
    valid = rows.where(F.col("key").isNotNull())
    distinct = common.cut(valid.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min("label").alias("label"), F.min("vec").alias("vec")))
    sample = [unit(x.vec) for x in distinct.orderBy(F.xxhash64("key")).select("vec").limit(fit_rows).collect()]
    forest = rows.sparkSession.sparkContext.broadcast(Forest(sample, distinct.count(), least, trees, spill, leaf))
    # Links of vectors without an id count for the others under a stand-in below all ids, one for each vector.
    nodes = distinct.withColumn("id", F.coalesce("id", -F.abs(F.xxhash64("key")) - 1))
    found = common.cut(_linked(_units(_placed(nodes, forest, block), block), least))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = components(found.select("id", "root"), "id", "root").select(F.col("node").alias("id"), "root")
    joined = common.cut(nodes.join(links, "id", "left").join(named, "id", "left").withColumn("root", F.coalesce("root", "id")).drop("vec"))
    least_id = joined.join(distinct.select("key", F.col("id").alias("own")), "key").groupBy("root").agg(F.min("own").alias("component_id"))
    out = common.keyed(joined, least_id, "root").select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    every = common.keyed(rows.select("vec_id", "key"), common.cut(out), "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and what they reach.
SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT r, r AS at FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.at),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.at GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, coalesce(v.vec_id = c.component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
