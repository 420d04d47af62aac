"""Retrieval metrics over ranked lists (query_id, doc_id, rank, score, gold), one aggregation for all of a query's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit(k: int, gold: str = "gold") -> Column:
    return F.max(F.when((F.col("rank") <= k) & F.col(gold), 1.0).otherwise(0.0))


def first_rank(k: int | None = None, gold: str = "gold") -> Column:
    good = F.col(gold) if k is None else F.col(gold) & (F.col("rank") <= k)
    return F.min(F.when(good, F.col("rank")))


def reciprocal(k: int | None = None, gold: str = "gold") -> Column:
    return F.coalesce(1.0 / first_rank(k, gold), F.lit(0.0))


def ideal(n: Column, k: int) -> Column:
    """Discounted gain of n gold results in the first places of k."""
    places = F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int"))
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))


def per_query(hits: DataFrame, sizes: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Metrics by query for hits, and sizes (query_id, n_gold); null metrics where a query has no gold. A document that stands twice counts once."""
    last = max(ks)
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")))
    gain = F.sum(F.when((F.col("rank") <= last) & F.col("gold") & (F.col("_n") == 1), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    found = F.count_distinct(F.when((F.col("rank") <= last) & F.col("gold"), F.col("doc_id")))
    out = once.groupBy("query_id").agg(*[hit(k).alias(f"hit_{k}") for k in ks], reciprocal().alias("mrr"), reciprocal(last).alias(f"mrr_{last}"), gain.alias("dcg"), found.alias("found"), F.count("*").alias("n_results"), F.count_distinct("doc_id").alias("n_distinct"))
    out = sizes.join(out, "query_id", "left")
    none = F.col("n_gold") == 0
    zero = lambda c: F.when(none, None).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    ndcg = F.when(~none, F.round(F.coalesce("dcg", F.lit(0.0)) / ideal(F.col("n_gold"), last), 6))
    return out.select("query_id", "n_gold", *[zero(f"hit_{k}").alias(f"hit_{k}") for k in ks], F.round(zero("mrr"), 6).alias("mrr"), F.round(zero(f"mrr_{last}"), 6).alias(f"mrr_{last}"), ndcg.alias("ndcg"), F.when(~none, F.round(F.coalesce("found", F.lit(0)) / F.col("n_gold"), 6)).alias("recall"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def quality(h1: Column, h5: Column, mrr: Column, ndcg: Column) -> Column:
    """The composite of four metrics; null if one is."""
    return F.round(0.30 * h1 + 0.25 * h5 + 0.25 * mrr + 0.20 * ndcg, 6)


def efficiency(score: Column, p95: Column) -> Column:
    return F.when(p95 > 0, F.round(score / F.log1p(p95), 6))
