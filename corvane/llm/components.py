"""Connected components of an edge table by alternating large-star and small-star steps.

A round is some ten stages whose plans the driver makes anew, whatever the number of edges. A caller may let a task close tables of up to
`CHUNK` edges (16 MB, what a task holds anyway), so that only larger ones go by rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

CHUNK, SALTS = 1_000_000, 8


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of these edges, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, least):
            return nodes, nodes[least]
        least = new


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges of the same components: each task links what it has read, a chunk at a time, to the least node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            nodes, least = roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            inner = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(least[inner])], ["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append((np.asarray(batch[0]), np.asarray(batch[1])))
            n += batch.num_rows
            if n >= CHUNK:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def _closed(edges: DataFrame) -> DataFrame:
    """node, root of edges (u, v) that one task holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [(np.asarray(x[0]), np.asarray(x[1])) for x in batches]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _met(edges: DataFrame, by: str, other: str, least: DataFrame, how: str) -> DataFrame:
    """Edges with column m of `least` (x, m) for their node `by`; a node's edges are spread by their other end."""
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    least = least.select(F.col("x").alias(by), "m", each)
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(least, [by, "salt"], how).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", whole: int = 0) -> DataFrame:
    """node, root: the least node reachable, for every node of an edge between two nodes. Edges may repeat and stand either way round.

    Edges (u, v) run from the greater node to the lesser. A large-star step hangs each u on the least node next to v; a small-star step
    hangs u and all but its least neighbour on that neighbour. Rounds end when the edges no longer change, and each is cut from its lineage.
    Where tasks leave no more than `whole` edges of all, one closes them without rounds.
    """
    now = common.cut(_contracted(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")))
    if whole and now.count() <= whole:
        return _closed(now)
    last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last = mark
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        large = _met(now, "v", "u", least, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = _met(large, "u", "v", least, "inner")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = common.cut(small.where("u <> v").distinct())
