"""Reports of runs: what was evaluated, skipped or failed, means of measures and the spread of latencies, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import quantiles


def summarized(rows: DataFrame, by: str, error: Column, skipped: Column, measures: list[str], times: list[str]) -> DataFrame:
    """by, row_count, evaluated, skipped, errors; mean_ of each measure over evaluated rows that have it, null without any; of each time over evaluated
    rows mean_, p50_ (the median), p95_ (nearest rank) and max_, 0 without any. A group is spread over tasks: its quantiles are selected in bins."""
    own = rows.select(F.col(by), error.alias("_error"), skipped.alias("_skipped"), *measures, *times)
    own = own.withColumn("_good", ~F.coalesce("_error", F.lit(False)) & ~F.coalesce("_skipped", F.lit(False)))
    good = lambda c: F.when(F.col("_good"), F.col(c))
    sums = [F.count("*").alias("row_count"), F.count_if("_good").alias("evaluated"), F.count_if("_skipped").alias("skipped"), F.count_if("_error").alias("errors")]
    sums += [F.round(F.avg(good(c)), 4).alias(f"mean_{c}") for c in measures]
    sums += [x for c in times for x in (F.round(F.coalesce(F.avg(good(c)), F.lit(0.0)), 3).alias(f"mean_{c}"), F.round(F.coalesce(F.max(good(c)), F.lit(0.0)), 3).alias(f"max_{c}"))]
    out = own.groupBy(by).agg(*sums)
    live = own.where("_good")
    for c in times:
        half = quantiles.linear(live, [by], c, {f"p50_{c}": 0.5}).withColumnRenamed(by, "_by")
        late = quantiles.nearest_ranks(live, by, c, {f"p95_{c}": 0.95}).withColumnRenamed(by, "_by")
        for part, name in ((half, f"p50_{c}"), (late, f"p95_{c}")):
            out = out.join(part, out[by].eqNullSafe(part["_by"]), "left").drop("_by").withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 3))
    return out


def answer_gain(rows: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """by, n, gain: the mean difference of recall after and before, over rows that have both; null without any."""
    both = F.col(before).isNotNull() & F.col(after).isNotNull()
    return rows.groupBy(by).agg(F.count_if(both).alias("n"), F.round(F.avg(F.when(both, F.col(after) - F.col(before))), 4).alias("gain"))
