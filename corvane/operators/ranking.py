"""Fusion, diversity, caps, boosts and blends of ranked lists, as windows over (query, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.retrieval import ranked


def rrf(lists: list[DataFrame], k: int = 60, limit: int = 10, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of (query, key, rank) lists; ties go to the earlier list, then the better rank."""
    every = None
    for i, one in enumerate(lists):
        part = one.select(by, key, "rank", F.lit(i).alias("list")).where(F.col(key).isNotNull())
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(by, key).agg(F.round(F.sum(1.0 / (max(k, 1) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(fused, by, F.desc("score"), "first.list", "first.rank", key, k=limit).select(by, key, "score", "rank")


def mmr(pool: DataFrame, weight: float, penalties: dict[str, float], limit: int, by: str = "query_id", score: str = "score", pos: str = "pos") -> DataFrame:
    """Greedy diversity with a constant penalty for a group that is already chosen, as windows.

    A row's value changes once, when the best of its group is chosen, so it is known from its place in the group. With several groups,
    each must be a function of the first. Rows with a null group are never penalised.
    """
    gain = F.lit(weight) * F.col(score)
    loss = [F.when(F.col(g).isNotNull() & (F.row_number().over(Window.partitionBy(by, g).orderBy(F.desc(gain), pos)) > 1), F.lit(p)).otherwise(F.lit(0.0)) for g, p in penalties.items()]
    value = F.round(gain - F.lit(1 - weight) * (F.greatest(*loss) if len(loss) > 1 else loss[0]), 9)
    return ranked(pool.withColumn("value", value), by, F.desc("value"), pos, k=limit)


def capped(pool: DataFrame, key: Column, cap: int, by: str = "query_id", pos: str = "pos") -> DataFrame:
    """Adds kept: whether a row is among the first `cap` of its key; rows with an empty key are all kept."""
    place = F.row_number().over(Window.partitionBy(by, key).orderBy(pos))
    return pool.withColumn("kept", (place <= cap) | (F.coalesce(key.cast("string"), F.lit("")) == ""))


def min_max(score: str, by: str = "query_id") -> Column:
    """The score within its pool's range; 0.5 where the pool has one value."""
    w = Window.partitionBy(by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.when(span <= 0, F.lit(0.5)).otherwise((F.col(score) - low) / span)


def blended(pool: DataFrame, scores: dict[str, float], by: str = "query_id", pos: str = "pos", limit: int = 10) -> DataFrame:
    """The weighted mean of scores by their ranges, weights divided by their sum."""
    total = sum(scores.values())
    value = sum((min_max(c, by) * F.lit(w / total) for c, w in scores.items()), F.lit(0.0))
    return ranked(pool.withColumn("blend", F.round(value, 9)), by, F.desc("blend"), pos, k=limit)


def boosted(pool: DataFrame, boosts: list[Column], most: float, by: str = "query_id", score: str = "score", pos: str = "pos") -> DataFrame:
    """Order by the score and the sum of boosts, which stops at `most` if that is positive; equal values keep their order."""
    total = sum(boosts, F.lit(0.0))
    total = F.least(total, F.lit(most)) if most > 0 else total
    out = pool.withColumn("boost", F.round(total, 6)).withColumn("final_score", F.round(F.col(score) + total, 6))
    return ranked(out, by, F.desc("final_score"), pos)


def path_overlap(path: Column, wanted: Column) -> Column:
    """1 for equal paths, 0.5 where one begins the other, else up to 0.4 by the share of wanted parts."""
    begins = lambda a, b: F.slice(b, 1, F.greatest(F.size(a), F.lit(1))) == a
    part = 0.4 * F.size(F.array_intersect(path, wanted)) / F.greatest(F.size(F.array_distinct(wanted)), F.lit(1))
    none = (F.size(path) <= 0) | (F.size(wanted) <= 0)
    return F.when(none, 0.0).when(path == wanted, 1.0).when(begins(path, wanted) | begins(wanted, path), 0.5).otherwise(part)
