"""Exact quantiles by selection: rows fall into bins between approximate cut points, and only the bins that hold a wanted rank are ordered."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources import scratch

BINS = 128


Rank = Callable[[Column], Column]


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Rank], bins: int = BINS) -> DataFrame:
    """by, n_values, and under each name the value at the rank (from 1) that its function makes of the number of the group's values; nulls don't count.

    Values are counted first, so that repeated ones are one row. No task holds a group: cut points come from a sketch, bins are counted
    where the rows are, and a window runs over the values of one bin and over one row for each bin. A sketch depends on the order in which
    its parts arrive, so it is made once and written: bins are the same where they are counted and where ranks are looked for.
    """
    own = rows.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    counts = own.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    cuts = own.groupBy(*by).agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)], F.lit(10_000)).alias("_cuts"), F.count("_v").alias("_all"))
    cuts = scratch.written(cuts)

    def met(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        """Joined by groups, a null group being one too."""
        b = b.select(*[F.col(c).alias(f"_by_{c}") for c in [*by, *more]], *[c for c in b.columns if c not in (*by, *more)])
        on = [a[c].eqNullSafe(b[f"_by_{c}"]) for c in [*by, *more]]
        return a.join(b, reduce(lambda x, y: x & y, on, F.lit(True))).drop(*[f"_by_{c}" for c in [*by, *more]])

    binned = met(counts, cuts).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sizes = binned.groupBy(*by, "_all", "_bin").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.least(of(F.col("_all")).cast("long"), F.col("_all")), F.lit(1)).alias("rank")) for name, of in ranks.items()])).alias("_w")
    at = sizes.select("*", wanted).where((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_size")))
    at = at.select(*by, "_bin", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_before")).alias("_rank"))
    upto = Window.partitionBy(*by, "_bin", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = met(binned, at, "_bin").withColumn("_upto", F.sum("_n").over(upto))
    found = found.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    return found.groupBy(*by).agg(F.max("_all").alias("n_values"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def nearest_ranks(rows: DataFrame, by: str | list[str], value: str, ps: dict[str, float], bins: int = BINS) -> DataFrame:
    """by, and under each name the value at rank ceil(p * n)."""
    ranks = {name: (lambda n, p=p: F.ceil(F.round(F.lit(p) * n, 9))) for name, p in ps.items()}
    return at_ranks(rows, [by] if isinstance(by, str) else by, value, ranks, bins).drop("n_values")


def rounded_ranks(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """by, and under each name the value at the place (n - 1) p from 0, rounded, halves to even."""
    return at_ranks(rows, by, value, {name: (lambda n, p=p: F.bround((n - 1) * F.lit(p)) + 1) for name, p in ps.items()}).drop("n_values")


def linear(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """by, and under each name the value at the place (n - 1) p from 0, between its two neighbours in proportion; a median is 0.5."""
    low = {f"_low_{name}": (lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1) for name, p in ps.items()}
    high = {f"_high_{name}": (lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1) for name, p in ps.items()}
    found = at_ranks(rows, by, value, low | high)
    part = lambda p: (F.col("n_values") - 1) * F.lit(p) - F.floor((F.col("n_values") - 1) * F.lit(p))
    return found.select(*by, *[(F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * part(p)).alias(k) for k, p in ps.items()])
