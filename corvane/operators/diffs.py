"""What changed between two versions of a table, by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, kind (added, removed, changed, same), fields: a map of each field that differs to how: set, cleared or changed. One full outer join; a key
    has one row a version, and a null key is a key of its own on either side."""
    a = old.select(F.col(key).alias("_a"), F.struct(*fields).alias("old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*fields).alias("new"))
    own = a.join(b, a._a == b._b, "full")
    how = lambda c: F.when(F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), None).when(F.col(f"old.{c}").isNull(), "set").when(F.col(f"new.{c}").isNull(), "cleared").otherwise("changed")
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), how(c).alias("value")) for c in fields]), lambda x: x.value.isNotNull())
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    found = F.when(both, F.map_from_entries(entries)).otherwise(F.create_map().cast("map<string,string>"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(found) > 0, "changed").otherwise("same")
    return own.select(F.coalesce("_a", "_b").alias(key), kind.alias("kind"), found.alias("fields"))


def field_counts(diff: DataFrame) -> DataFrame:
    """field, how, n: rows by kind (field null), and fields by how they changed."""
    rows = diff.groupBy(F.col("kind").alias("how")).agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("field"), "how", "n")
    return rows.unionByName(diff.select(F.explode("fields").alias("field", "how")).groupBy("field", "how").agg(F.count("*").alias("n")))


def broken_down(old: DataFrame, new: DataFrame, key: str, text: str, same: list[str], groups: dict[str, list[str]], most: int = 10) -> DataFrame:
    """dimension, value, total, changed, share: how often `text` changed, by each group's values, the first of most changes, and in all (dimension all); and how many
    rows differ in another field that has to be the same (dimension integrity). groups names columns of old by dimension; nulls and blanks are <unknown>."""
    pairs = old.select(key, F.col(text).alias("_a"), F.struct(*same).alias("_s"), *{c for cs in groups.values() for c in cs}).join(new.select(key, F.col(text).alias("_b"), F.struct(*same).alias("_t")), key)
    pairs = pairs.withColumn("_changed", (~F.col("_a").eqNullSafe(F.col("_b"))).cast("int")).withColumn("_broken", (F.col("_s") != F.col("_t")).cast("int"))
    value = lambda cs: F.concat_ws("/", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("<unknown>")) for c in cs])
    each = [F.struct(F.lit(name).alias("dimension"), value(cs).alias("value"), F.col("_changed").alias("c")) for name, cs in groups.items()]
    each += [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"), F.col("_changed").alias("c")), F.struct(F.lit("integrity").alias("dimension"), F.lit("").alias("value"), F.col("_broken").alias("c"))]
    counts = pairs.select(F.explode(F.array(*each)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("total"), F.sum("x.c").alias("changed"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("changed")).alias("a"), (-F.col("total")).alias("b"), "value", "total", "changed")))
    # A dimension has as many values as its columns, and the report has the first of them; sums are small by then.
    top = counts.groupBy("dimension").agg(F.slice(best, 1, most).alias("top")).select("dimension", F.explode("top").alias("t"))
    return top.select("dimension", "t.value", "t.total", "t.changed", F.round(F.col("t.changed") / F.col("t.total"), 6).alias("share"))
