"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule: knots (time, weight), time from 0 to 1, linear in between. The schedule's integral is the
source's weight; the weights share out all words, a source's target stops at `cap` times its size, and what is over goes to
the others by weight until none is above. Reading a source's documents in a fixed pseudo-random order, again and again, gives
each copy the words that came before it; the time at which the source's cumulative demand, the integral of its schedule,
reaches those words is the copy's training position. The range-sorted copies are the training order.

Sums within a source run over 4,096 buckets of it, so a source of any share of the rows is spread over tasks; only one row per
source and bucket meets in a window of a source. Sums over sources run within range partitions and over one row for each of these.

Defined results: a null or blank text has size 0 and is not taken. A null source is a source, last in order. A null doc_id
counts as the id ''. Repeated rows are documents of their own. Copies are whole: in its last turn a source takes the documents whose
middle word is within its target, so what it takes is off by half of one document at most. Rows of one id are ordered by size, then by
text. Further columns are not looked at, unless `keep` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.common import WORD

#: Schedules in turn for the sources in order; their integrals are 5, 2 and 1: the first fades, the last grows.
CURRICULUM = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
CAP = 3


def integral(knots: tuple) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))


def inverse(share: Column, knots: tuple) -> Column:
    """The time at which the schedule's integral reaches this share of its whole."""
    total, done, out = integral(knots), 0.0, F.lit(1.0)
    parts = []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (a + b) / 2
        x = share * F.lit(total) - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / (t1 - t0)) * x, F.lit(0.0)))
        parts.append((done + area, F.when(x <= 0, F.lit(t0)).otherwise(F.lit(t0) + 2 * x / (F.lit(a) + root)) if area else F.lit(t0)))
        done += area
    for end, at in reversed(parts):
        out = F.when(share * F.lit(total) < F.lit(end), at).otherwise(out)
    return out


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over the rows before each one, and under the name with _all those over all rows. Rows are dealt by range; only one
    row for each range is summed in one task."""
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = common.cut(dealt)
    parts = dealt.groupBy("_range").agg(*[F.sum(x).alias(f"_{k}") for k, x in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums], *[F.sum(f"_{k}").over(Window.partitionBy()).alias(f"{k}_all") for k in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.join(F.broadcast(parts), "_range")  # one row for each range partition
    for k, x in sums.items():
        dealt = dealt.withColumn(k, F.col(f"_{k}_before") + F.coalesce(F.sum(x).over(within), F.lit(0)))
    return dealt.drop("_range", *[f"_{k}_before" for k in sums])


def targets(sources: DataFrame, weights: list[float], cap: int) -> DataFrame:
    """source_size -> kind (place in the cycle of weights) and target: the level at which all words are shared under the caps."""
    own = running(sources, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    own = own.withColumn("kind", F.pmod(F.col("place"), F.lit(len(weights))).cast("int")).drop("place", "place_all")
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1)).withColumn("most", F.col("source_size") * cap)
    own = running(own, [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")], {"filled": F.col("most"), "used": F.col("weight"), "words": F.col("source_size")})
    level = (F.col("words_all") - F.col("filled")) / (F.col("used_all") - F.col("used"))
    own = own.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    highest = own.agg(F.max("level").alias("highest"))
    own = own.crossJoin(F.broadcast(highest))  # one row
    return own.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("highest") * F.col("weight"), F.col("most").cast("double"))))


def assign(docs: DataFrame, schedules: tuple = CURRICULUM, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions (one for each copy, in order), rest (place in the source for what isn't taken).

    Sizes are counted once and cut from their lineage, unless `keep` names the text, which would be written with them.
    """
    columns = list(dict.fromkeys(["doc_id", "text", "source", *keep]))
    own = common.pick(docs, *columns).withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    own = own.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("_bucket", F.substring("_order", 1, 3))
    own = own.withColumn("_tie", F.xxhash64("text")).withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    own = own.select("_source", "_bucket", "_order", "_tie", "_size", *[c for c in columns if c in ("doc_id", "source") or c in keep])
    own = own if "text" in keep else common.cut(own)
    buckets = own.groupBy("_source", "_bucket").agg(F.sum("_size").alias("words"))
    sources = buckets.groupBy("_source").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("_source") != "n", F.expr("substring(_source, 2)")))
    shares = targets(sources, [integral(x) for x in schedules], cap).select("_source", "kind", "source_size", "target")
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(running), F.lit(0))).join(shares, "_source").drop("words")
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(buckets, ["_source", "_bucket"])

    size, whole, start, goal = F.col("_size"), F.col("source_size"), F.col("offset") + F.col("_before"), F.floor(F.col("target") + 0.5)
    full = F.when(whole > 0, F.floor(goal / F.greatest(whole, F.lit(1)))).otherwise(0)
    rest = goal - full * whole
    copies = F.when(size > 0, full + F.when(2 * start + size <= 2 * rest, 1).otherwise(0)).otherwise(0)
    taken = copies * size
    share = lambda k: (start + (k - 1) * whole) / F.greatest(goal, F.lit(1))

    def position(k: Column) -> Column:
        out = inverse(share(k), schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            out = F.when(F.col("kind") == i, inverse(share(k), knots)).otherwise(out)
        return out

    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(1).cast("long"), copies.cast("long")), position)).otherwise(F.array().cast("array<double>"))
    out = own.select(*[c for c in columns if c in ("doc_id", "source") or c in keep], size.alias("size"), whole.alias("source_size"), "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), positions.alias("positions"), (start / F.greatest(whole, F.lit(1))).alias("rest"))
    return out


def in_order(assigned: DataFrame) -> DataFrame:
    """All documents by the position of their first copy, range-partitioned; those not taken come after 1, by their place in the source."""
    first = F.coalesce(F.get("positions", F.lit(0)), 1 + F.col("rest"))
    return assigned.withColumn("position", first).repartitionByRange("position").sortWithinPartitions("position")


def training_copies(assigned: DataFrame) -> DataFrame:
    """One row for each copy, in training order."""
    each = assigned.select("*", F.posexplode("positions").alias("copy", "position"))
    return each.drop("positions").repartitionByRange("position").sortWithinPartitions("position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = in_order(assign(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def _sql_inverse(share: str, knots: tuple) -> str:
    total, done, cases = integral(knots), 0.0, []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        area, x = (t1 - t0) * (a + b) / 2, f"({share} * {total!r}::DOUBLE - {done!r}::DOUBLE)"
        cases.append(f"WHEN {share} * {total!r}::DOUBLE < {done + area!r}::DOUBLE THEN CASE WHEN {x} <= 0 THEN {t0!r}::DOUBLE ELSE {t0!r}::DOUBLE + 2 * {x} / ({a!r}::DOUBLE + sqrt(greatest({a * a!r}::DOUBLE + {2 * (b - a) / (t1 - t0)!r}::DOUBLE * {x}, 0))) END")
        done += area
    return f"CASE {' '.join(cases)} ELSE 1.0 END"


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind, 3 * source_size AS most FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(most::DOUBLE, coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most::DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.kind, floor(t.target + 0.5)::BIGINT AS goal,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p),
r AS (SELECT *, goal - whole * source_size AS rest, start::DOUBLE / greatest(goal, 1) AS share FROM q),
c AS (SELECT *, (CASE WHEN size > 0 THEN whole + CASE WHEN 2 * start + size <= 2 * rest THEN 1 ELSE 0 END ELSE 0 END)::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN CASE kind WHEN 0 THEN {_sql_inverse("share", CURRICULUM[0])} WHEN 1 THEN {_sql_inverse("share", CURRICULUM[1])} ELSE {_sql_inverse("share", CURRICULUM[2])} END
  ELSE 1 + start::DOUBLE / greatest(source_size, 1) END AS position
FROM c
"""
