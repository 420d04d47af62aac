"""Catalogue tables: latest versions, upserts, incremental changes, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def change_kinds(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: unchanged, changed or new, by digests; and gone for keys that the incoming rows lack."""
    old = existing.select(key, F.col(digest).alias("_old"))
    both = old.join(incoming.select(key, F.col(digest).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def with_next_ids(rows: DataFrame, start: int, bucket: Column, order: str) -> DataFrame:
    """Consecutive ids from `start`, in order of (bucket, order), by sums over buckets and a window in each."""
    own = rows.withColumn("_b", bucket)
    sizes = own.groupBy("_b").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.join(sizes.select("_b", before.alias("_before")), "_b")
    return own.withColumn("row_id", F.lit(start) + F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1).drop("_b", "_before")


def stratified(rows: DataFrame, by: list[str], n: int, key: str, seed: str = "") -> DataFrame:
    """n rows of each stratum, by a seeded digest of the key."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).where(F.col("_n") <= n).drop("_n")


def evenly_spaced(rows: DataFrame, by: str, n: int, order: str) -> DataFrame:
    """Up to n rows of each group at even distances in order; places are rounded halves to even and stop at the last."""
    size = F.count("*").over(Window.partitionBy(by))
    own = rows.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("_size", size)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.bround(i * F.col("_size") / n), F.col("_size") - 1).cast("int")))
    return own.where(F.array_contains(places, F.col("_i").cast("int"))).drop("_i", "_size")
