"""Queries of retrieval evaluation: metrics, comparisons, verdicts, recoveries, frontiers and gates.

The dense ranking of 64 components is the candidate, that of the first 16 the baseline; a result is gold if its label is the query's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import decisions, metrics, quantiles
from corvane.plans.registry import neighbours_sql, query
from corvane.plans.search import neighbours, questions, vectors
from corvane.sources.tables import table

BASE, CAND = neighbours_sql(10, 16, "b"), neighbours_sql(10, 64, "h")
SIZES = "z AS (SELECT q.vec_id AS query_id, count(*) AS n_gold FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1)"


def metrics_sql(source: str, out: str) -> str:
    return f"""{out} AS (SELECT z.query_id, n_gold, max(CASE WHEN rank <= 1 AND gold THEN 1.0 ELSE 0 END)::DOUBLE AS hit_1, max(CASE WHEN rank <= 3 AND gold THEN 1.0 ELSE 0 END)::DOUBLE AS hit_3,
  max(CASE WHEN rank <= 5 AND gold THEN 1.0 ELSE 0 END)::DOUBLE AS hit_5, max(CASE WHEN gold THEN 1.0 ELSE 0 END)::DOUBLE AS hit_10, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE gold), 0), 6) AS mrr_10,
  round(coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE gold), 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg,
  round(count(*) FILTER (WHERE gold) / n_gold::DOUBLE, 6) AS recall FROM z LEFT JOIN {source} USING (query_id) GROUP BY z.query_id, n_gold)"""


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf)
    n = own.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    return questions(spark, sf).select("query_id", F.col("q_label").alias("label")).join(n, "label").select("query_id", "n_gold")


def measured(spark: SparkSession, sf: str, dims: int = 64) -> DataFrame:
    return metrics.per_query(neighbours(spark, sf, 10, dims), sizes(spark, sf))


NAMES = ("hit_1", "hit_3", "hit_5", "hit_10", "mrr_10", "ndcg", "recall")


@query(f"WITH {CAND}, {SIZES}, {metrics_sql('h', 'm')} SELECT * FROM m")
def hit_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return measured(spark, sf).select("query_id", "n_gold", *NAMES)


@query(f"WITH {CAND}, {SIZES}, {metrics_sql('h', 'm')} SELECT count(*) AS n, round(avg(hit_1), 6) AS hit_1, round(avg(hit_5), 6) AS hit_5, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM m")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return measured(spark, sf).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_5", "mrr_10", "ndcg", "recall")])


GRADES = "CASE WHEN q_label = label THEN 2 WHEN abs(q_label - label) = 1 THEN 1 ELSE 0 END"


@query(f"""WITH {CAND}, g AS (SELECT q.vec_id AS query_id, {GRADES.replace('q_label', 'q.label').replace(' label', ' e.label')} AS grade FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM g) WHERE n <= 10 GROUP BY query_id)
SELECT query_id, round(sum((pow(2, {GRADES}) - 1) / log2(rank + 1)) / best, 6) AS ndcg FROM h JOIN i USING (query_id) GROUP BY query_id, best""")
def graded_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    """Gain 2^grade - 1, grade 2 for the query's label and 1 for one next to it; the ideal needs only how many of each grade there are."""
    grade = lambda a, b: F.when(a == b, 2).when(F.abs(a - b) == 1, 1).otherwise(0)
    counts = vectors(spark, sf).groupBy("label").count().select(F.col("label").alias("other"), "count")
    beside = F.explode(F.array(*[F.col("q_label") + i for i in (-1, 0, 1)])).alias("other")
    q = questions(spark, sf).select("query_id", "q_label", beside).join(counts, "other")
    n = lambda g: F.sum(F.when(grade(F.col("q_label"), F.col("other")) == g, F.col("count") - F.when(F.lit(g) == 2, 1).otherwise(0)).otherwise(0))
    ideal = q.groupBy("query_id").agg(n(2).alias("two"), n(1).alias("one"))
    gain = F.when(F.col("i") <= F.col("two"), 3.0).when(F.col("i") <= F.col("two") + F.col("one"), 1.0).otherwise(0.0)
    ideal = ideal.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("i") + 1.0)).alias("best"))
    got = neighbours(spark, sf).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), grade(F.col("q_label"), F.col("label"))) - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    return got.join(ideal, "query_id").select("query_id", F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"))


@query(f"""WITH {CAND} SELECT query_id, round(1 - count(DISTINCT label) / count(*)::DOUBLE, 4) AS dup_rate, count(DISTINCT label) FILTER (WHERE rank <= 5) AS labels_5, round(1 - count(DISTINCT label) FILTER (WHERE rank <= 5) / 5.0::DOUBLE, 6) AS dup_ratio_5,
round(count(DISTINCT label % 4) / 10.0::DOUBLE, 6) AS diversity_10, max(n) AS modal_label FROM (SELECT *, count(*) OVER (PARTITION BY query_id, label) AS n FROM h) GROUP BY query_id""")
def duplicate_ratios(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "label")))
    five = F.count_distinct(F.when(F.col("rank") <= 5, F.col("label")))
    return own.groupBy("query_id").agg(F.round(1 - F.count_distinct("label") / F.count("*"), 4).alias("dup_rate"), five.alias("labels_5"), F.round(1 - five / 5.0, 6).alias("dup_ratio_5"), F.round(F.count_distinct(F.col("label") % 4) / 10.0, 6).alias("diversity_10"), F.max("n").alias("modal_label"))


@query(f"""WITH {CAND}, g AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 2) AS b, arg_max(score, rank) AS z FROM h GROUP BY query_id)
SELECT query_id, round(a - z, 4) AS gap, round((a - z) / abs(a), 4) AS relative_gap, round(a - b, 6) AS margin FROM g""")
def topk_gap_margin(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"), F.max_by("score", "rank").alias("z"))
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    return own.select("query_id", F.round(a - z, 4).alias("gap"), F.round((a - z) / F.abs(a), 4).alias("relative_gap"), F.round(a - b, 6).alias("margin"))


@query(f"""WITH {CAND}, {SIZES}, {metrics_sql('h', 'm')}, l AS (SELECT quantile_disc(value, 0.95) AS p95 FROM events),
s AS (SELECT round(0.30::DOUBLE * avg(hit_1) + 0.25::DOUBLE * avg(hit_5) + 0.25::DOUBLE * avg(mrr_10) + 0.20::DOUBLE * avg(ndcg), 6) AS quality FROM m)
SELECT quality, round(quality / ln(1 + p95), 6) AS efficiency FROM s, l""")
def quality_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    own = measured(spark, sf).agg(*[F.avg(c).alias(c) for c in ("hit_1", "hit_5", "mrr_10", "ndcg")])
    own = own.select(metrics.quality(F.col("hit_1"), F.col("hit_5"), F.col("mrr_10"), F.col("ndcg")).alias("quality"))
    late = quantiles.nearest_ranks(table(spark, sf, "events").select(F.lit(0).alias("all"), "value"), "all", "value", {"p95": 0.95}).select("p95")
    return own.crossJoin(F.broadcast(late)).select("quality", metrics.efficiency(F.col("quality"), F.col("p95")).alias("efficiency"))  # one row each


PAIRED = f"WITH {BASE}, {CAND}, {SIZES}, {metrics_sql('b', 'x')}, {metrics_sql('h', 'y')}, p AS (SELECT y.query_id, x.hit_5 AS b5, y.hit_5 AS c5, x.mrr_10 AS bm, y.mrr_10 AS cm, x.hit_1 AS b1, y.hit_1 AS c1, q.label % 3 AS bucket, CASE WHEN y.mrr_10 > x.mrr_10 THEN 'improved' WHEN y.mrr_10 < x.mrr_10 THEN 'regressed' WHEN y.hit_10 > 0 THEN 'both_hit' ELSE 'both_missed' END AS status FROM x JOIN y USING (query_id) JOIN embeddings q ON q.vec_id = y.query_id)"


def paired(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda d, p: measured(spark, sf, d).select("query_id", F.col("hit_1").alias(f"{p}1"), F.col("hit_5").alias(f"{p}5"), F.col("mrr_10").alias(f"{p}m"), F.col("hit_10").alias(f"{p}10"))
    own = side(16, "b").join(side(64, "c"), "query_id").join(questions(spark, sf).select("query_id", (F.col("q_label") % 3).alias("bucket")), "query_id")
    status = decisions.first_rule([(F.col("cm") > F.col("bm"), "improved"), (F.col("cm") < F.col("bm"), "regressed"), (F.col("c10") > 0, "both_hit")], "both_missed")
    return own.withColumn("status", status)


@query(f"{PAIRED} SELECT query_id, b5, c5, bm, cm, round(cm - bm, 6) AS delta, status FROM p")
def ab_paired(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf).select("query_id", "b5", "c5", "bm", "cm", F.round(F.col("cm") - F.col("bm"), 6).alias("delta"), "status")


@query(f"""{PAIRED} SELECT coalesce(bucket::VARCHAR, 'all') AS bucket, count(*) AS n, round(avg(b5), 6) AS base_hit_5, round(avg(c5), 6) AS cand_hit_5, count(*) FILTER (WHERE status = 'improved') AS improved, count(*) FILTER (WHERE status = 'regressed') AS regressed,
count(*) FILTER (WHERE status = 'both_hit') AS both_hit, count(*) FILTER (WHERE status = 'both_missed') AS both_missed FROM p GROUP BY GROUPING SETS ((bucket), ())""")
def ab_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    own = paired(spark, sf).rollup("bucket").agg(F.count("*").alias("n"), F.round(F.avg("b5"), 6).alias("base_hit_5"), F.round(F.avg("c5"), 6).alias("cand_hit_5"), *[F.count_if(F.col("status") == s).alias(s) for s in ("improved", "regressed", "both_hit", "both_missed")])
    return own.withColumn("bucket", F.coalesce(F.col("bucket").cast("string"), F.lit("all")))


@query(f"{PAIRED} SELECT b1 AS dense_hit, c1 AS rerank_hit, count(*) AS n, list_slice(list_sort(list(query_id)), 1, 10) AS samples FROM p GROUP BY b1, c1")
def rerank_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    own = paired(spark, sf).withColumn("n_", F.row_number().over(Window.partitionBy("b1", "c1").orderBy("query_id")))
    return own.groupBy(F.col("b1").alias("dense_hit"), F.col("c1").alias("rerank_hit")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("n_") <= 10, F.col("query_id")))).alias("samples"))


POOL50 = neighbours_sql(50)


@query(f"""WITH {POOL50}, r AS (SELECT query_id, min(rank) FILTER (WHERE gold) AS first, max(CASE WHEN abs(label - q_label) = 1 AND rank <= 5 THEN 1 ELSE 0 END) AS near FROM h GROUP BY query_id)
SELECT CASE WHEN first = 1 THEN 'top' WHEN first <= 5 THEN 'shown' WHEN first <= 10 THEN 'just_below' WHEN first <= 50 THEN 'in_pool' WHEN near = 1 THEN 'near_miss' ELSE 'not_found' END AS bucket, count(*) AS n, round(avg(first), 6) AS mean_rank FROM r GROUP BY 1""")
def miss_buckets(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf, 50).groupBy("query_id").agg(metrics.first_rank().alias("first"), F.max(((F.abs(F.col("label") - F.col("q_label")) == 1) & (F.col("rank") <= 5)).cast("int")).alias("near"))
    bucket = decisions.first_rule([(F.col("first") == 1, "top"), (F.col("first") <= 5, "shown"), (F.col("first") <= 10, "just_below"), (F.col("first") <= 50, "in_pool"), (F.col("near") == 1, "near_miss")], "not_found")
    return own.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("first"), 6).alias("mean_rank"))


@query(f"""WITH {POOL50} SELECT query_id, count(*) AS recoverable, min(rank) AS best FROM h WHERE gold AND rank > 5 AND query_id NOT IN (SELECT query_id FROM h WHERE gold AND rank <= 5) GROUP BY query_id""")
def pool_recoverable(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf, 50).where("gold")
    return own.join(own.where("rank <= 5").select("query_id"), "query_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("recoverable"), F.min("rank").alias("best"))


SIGNALS = f"""WITH {CAND}, s AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS top, max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) AS margin, max(n) / count(*)::DOUBLE AS same_page,
  1 - count(DISTINCT label) / count(*)::DOUBLE AS dup, count(*) FILTER (WHERE label % 5 = 0) AS generic, count(*) AS evidence, coalesce(min(rank) FILTER (WHERE gold), -1) AS gold_rank FROM (SELECT *, count(*) OVER (PARTITION BY query_id, label) AS n FROM h) GROUP BY query_id),
v AS (SELECT *, list_filter([CASE WHEN top < 0.55 THEN 'LOW_TOP1_SCORE' END, CASE WHEN evidence < 2 THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN same_page < 0.30 THEN 'PAGE_ID_DISAGREEMENT' END, CASE WHEN gold_rank = -1 THEN 'GOLD_NOT_IN_CANDIDATES' END,
  CASE WHEN margin < 0.04 THEN 'LOW_MARGIN' END, CASE WHEN generic > 6 THEN 'GENERIC_COLLISION' END, CASE WHEN dup > 0.90 THEN 'HIGH_DUPLICATE_RATE' END, CASE WHEN gold_rank > 5 THEN 'GOLD_LOW_RANK' END], lambda x: x IS NOT NULL) AS reasons FROM s),
c AS (SELECT *, CASE WHEN gold_rank = -1 THEN 'FAILED' WHEN len(list_intersect(reasons, ['LOW_TOP1_SCORE', 'INSUFFICIENT_EVIDENCE', 'PAGE_ID_DISAGREEMENT'])) > 0 THEN 'LOW_CONFIDENCE' WHEN len(reasons) > 0 THEN 'AMBIGUOUS' ELSE 'CONFIDENT' END AS label,
  CASE WHEN 'INSUFFICIENT_EVIDENCE' IN (SELECT unnest(reasons)) THEN 'INSUFFICIENT_EVIDENCE' WHEN gold_rank = -1 THEN 'HYBRID_RECOVERY' WHEN list_contains(reasons, 'LOW_TOP1_SCORE') OR list_contains(reasons, 'GOLD_LOW_RANK') THEN 'QUERY_REWRITE' WHEN list_contains(reasons, 'PAGE_ID_DISAGREEMENT') OR list_contains(reasons, 'GENERIC_COLLISION') THEN 'ASK_CLARIFICATION' WHEN len(reasons) > 0 THEN 'ANSWER_WITH_CAUTION' ELSE 'ANSWER' END AS action FROM v)"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "label")))
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    own = own.groupBy("query_id").agg(at(1).alias("top"), (at(1) - at(2)).alias("margin"), (F.max("n") / F.count("*")).alias("same_page"), (1 - F.count_distinct("label") / F.count("*")).alias("dup"), F.count_if(F.col("label") % 5 == 0).alias("generic"), F.count("*").alias("evidence"), F.coalesce(metrics.first_rank(), F.lit(-1)).alias("gold_rank"))
    c = F.col
    rules = [(c("top") < 0.55, "LOW_TOP1_SCORE", "QUERY_REWRITE"), (c("evidence") < 2, "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"), (c("same_page") < 0.30, "PAGE_ID_DISAGREEMENT", "ASK_CLARIFICATION"), (c("gold_rank") == -1, "GOLD_NOT_IN_CANDIDATES", "HYBRID_RECOVERY"), (c("margin") < 0.04, "LOW_MARGIN", "ANSWER_WITH_CAUTION"), (c("generic") > 6, "GENERIC_COLLISION", "ASK_CLARIFICATION"), (c("dup") > 0.90, "HIGH_DUPLICATE_RATE", "ANSWER_WITH_CAUTION"), (c("gold_rank") > 5, "GOLD_LOW_RANK", "QUERY_REWRITE")]
    own = own.withColumn("reasons", decisions.all_reasons([(a, b) for a, b, _ in rules])).withColumn("label", decisions.confidence_label(c("reasons"), c("gold_rank") == -1))
    return own.withColumn("action", decisions.strongest(F.array_compact(F.array(*[F.when(a, F.lit(x)) for a, _, x in rules]))))


@query(f"{SIGNALS} SELECT query_id, round(top, 6) AS top, round(margin, 6) AS margin, gold_rank, array_to_string(reasons, ',') AS reasons, label, action FROM c")
def confidence_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("query_id", F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin"), "gold_rank", F.array_join("reasons", ",").alias("reasons"), "label", "action")


@query(f"{SIGNALS} SELECT 'label' AS kind, k.name, count(label) AS n FROM (VALUES ('CONFIDENT'), ('AMBIGUOUS'), ('LOW_CONFIDENCE'), ('FAILED')) k(name) LEFT JOIN c ON label = name GROUP BY ALL UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM c) GROUP BY r UNION ALL SELECT 'action', action, count(*) FROM c GROUP BY action")
def confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    own = verdicts(spark, sf)
    labels = spark.createDataFrame([(x,) for x in ("CONFIDENT", "AMBIGUOUS", "LOW_CONFIDENCE", "FAILED")], "name string")
    counted = labels.join(own.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")), "name", "left").select(F.lit("label").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    reasons = own.select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    return counted.unionByName(reasons).unionByName(own.groupBy(F.col("action").alias("name")).agg(F.count("*").alias("n")).select(F.lit("action").alias("kind"), "name", "n"))


@query(f"{SIGNALS} SELECT query_id, label, gold_rank, CASE WHEN label = 'CONFIDENT' THEN 'confident_but_wrong' ELSE 'doubted_but_right' END AS kind FROM c WHERE (label = 'CONFIDENT' AND gold_rank > 1) OR (label IN ('LOW_CONFIDENCE', 'FAILED') AND gold_rank = 1)")
def verdict_surprises(spark: SparkSession, sf: str) -> DataFrame:
    own = verdicts(spark, sf).where("(label = 'CONFIDENT' and gold_rank > 1) or (label in ('LOW_CONFIDENCE', 'FAILED') and gold_rank = 1)")
    return own.select("query_id", "label", "gold_rank", F.when(F.col("label") == "CONFIDENT", "confident_but_wrong").otherwise("doubted_but_right").alias("kind"))


RECOVERY = f"WITH {BASE}, {CAND}, x AS (SELECT query_id, min(rank) FILTER (WHERE gold) AS before FROM b GROUP BY 1), y AS (SELECT query_id, min(rank) FILTER (WHERE gold) AS after FROM h GROUP BY 1), r AS (SELECT query_id, before, after, CASE WHEN before IS NULL AND after IS NULL THEN NULL WHEN before IS NULL THEN -(11 - after) WHEN after IS NULL THEN 11 - before ELSE after - before END AS delta FROM x JOIN y USING (query_id))"


def recoveries(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda d, name: neighbours(spark, sf, 10, d).groupBy("query_id").agg(metrics.first_rank().alias(name))
    own = side(16, "before").join(side(64, "after"), "query_id")
    return own.withColumn("delta", decisions.rank_delta(F.col("before"), F.col("after"), 10))


@query(f"{RECOVERY} SELECT query_id, before, after, delta, CASE WHEN before IS NULL AND after IS NOT NULL THEN 'newly_entered' WHEN delta < 0 THEN 'recovered' WHEN delta > 0 THEN 'regression' ELSE 'unchanged' END AS outcome FROM r")
def recovery_classification(spark: SparkSession, sf: str) -> DataFrame:
    outcome = decisions.first_rule([(F.col("before").isNull() & F.col("after").isNotNull(), "newly_entered"), (F.col("delta") < 0, "recovered"), (F.col("delta") > 0, "regression")], "unchanged")
    return recoveries(spark, sf).select("query_id", "before", "after", "delta", outcome.alias("outcome"))


@query(f"{RECOVERY} SELECT k, count(*) FILTER (WHERE coalesce(before > k, TRUE) AND after <= k) AS num, count(*) FILTER (WHERE coalesce(before > k, TRUE)) AS denom, round(avg(delta), 6) AS mean_delta, median(delta) AS median_delta FROM r, (VALUES (1), (3), (5)) ks(k) GROUP BY k")
def recovered_at_k(spark: SparkSession, sf: str) -> DataFrame:
    own = recoveries(spark, sf).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    missed = F.coalesce(F.col("before") > F.col("k"), F.lit(True))
    sums = own.groupBy("k").agg(F.count_if(missed & (F.col("after") <= F.col("k"))).alias("num"), F.count_if(missed).alias("denom"), F.round(F.avg("delta"), 6).alias("mean_delta"))
    return sums.join(quantiles.linear(own, ["k"], "delta", {"median_delta": 0.5}), "k", "left")


@query(f"""WITH {CAND}, {SIZES}, {metrics_sql('h', 'm')}, w AS (SELECT m.*, 1.0::DOUBLE + q.label % 3 AS weight, q.label % 2 AS grp, q.label % 3 AS bucket FROM m JOIN embeddings q ON q.vec_id = m.query_id)
SELECT CASE WHEN GROUPING(grp) = 0 THEN 'group' WHEN GROUPING(bucket) = 0 THEN 'bucket' ELSE 'all' END AS cell, coalesce(grp, bucket, -1) AS value, count(*) AS n, round(sum(weight * hit_5) / sum(weight), 6) AS w_hit_5, round(sum(weight * mrr_10) / sum(weight), 6) AS w_mrr,
round(0.45::DOUBLE * sum(weight * hit_5) / sum(weight) + 0.35::DOUBLE * sum(weight * mrr_10) / sum(weight) + 0.20::DOUBLE * sum(weight * ndcg) / sum(weight), 6) AS primary_score, round(avg(hit_5) FILTER (WHERE weight > 1), 6) AS strict_hit_5
FROM w GROUP BY GROUPING SETS ((grp), (bucket), ())""")
def weighted_gold_summary(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).select("query_id", (1.0 + F.col("q_label") % 3).alias("weight"), (F.col("q_label") % 2).alias("grp"), (F.col("q_label") % 3).alias("bucket"))
    own = measured(spark, sf).join(q, "query_id")
    mean = lambda c: F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
    primary = 0.45 * mean("hit_5") + 0.35 * mean("mrr_10") + 0.20 * mean("ndcg")
    out = own.groupingSets([["grp"], ["bucket"], []], "grp", "bucket").agg(F.grouping("grp").alias("_g"), F.grouping("bucket").alias("_b"), F.count("*").alias("n"), F.round(mean("hit_5"), 6).alias("w_hit_5"), F.round(mean("mrr_10"), 6).alias("w_mrr"), F.round(primary, 6).alias("primary_score"), F.round(F.avg(F.when(F.col("weight") > 1, F.col("hit_5"))), 6).alias("strict_hit_5"))
    cell = F.when(F.col("_g") == 0, "group").when(F.col("_b") == 0, "bucket").otherwise("all")
    return out.select(cell.alias("cell"), F.coalesce("grp", "bucket", F.lit(-1)).alias("value"), "n", "w_hit_5", "w_mrr", "primary_score", "strict_hit_5")


@query(f"""{PAIRED} SELECT bucket, round(avg(c5) - avg(b5), 6) AS delta, CASE WHEN bucket = 0 THEN 0.05 ELSE 0.03 END::DOUBLE AS allowed, avg(c5) - avg(b5) <= -CASE WHEN bucket = 0 THEN 0.05 ELSE 0.03 END AS warned FROM p GROUP BY bucket""")
def silver_guardrail(spark: SparkSession, sf: str) -> DataFrame:
    own = paired(spark, sf).groupBy("bucket").agg((F.avg("c5") - F.avg("b5")).alias("d")).withColumn("allowed", F.when(F.col("bucket") == 0, 0.05).otherwise(0.03))
    return own.select("bucket", F.round("d", 6).alias("delta"), "allowed", (F.col("d") <= -F.col("allowed")).alias("warned"))


LEVELS = f"WITH {CAND}, a AS (SELECT *, {GRADES} AS level FROM h)"


@query(f"""{LEVELS}, q AS (SELECT query_id, k, max(CASE WHEN rank <= k AND level >= 1 THEN 1 ELSE 0 END) AS ans, max(CASE WHEN rank <= k AND level >= 2 THEN 1 ELSE 0 END) AS fully FROM a, (VALUES (1), (3), (5)) ks(k) GROUP BY ALL)
SELECT k, round(avg(ans), 6) AS answerable, round(avg(fully), 6) AS fully, count(*) FILTER (WHERE ans = 1 AND fully = 0) AS partial_only FROM q GROUP BY k""")
def answerability_rates(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("gold"), 2).when(F.abs(F.col("label") - F.col("q_label")) == 1, 1).otherwise(0)
    own = neighbours(spark, sf).withColumn("level", level).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    at = lambda n: F.max(((F.col("rank") <= F.col("k")) & (F.col("level") >= n)).cast("int"))
    own = own.groupBy("query_id", "k").agg(at(1).alias("ans"), at(2).alias("fully"))
    return own.groupBy("k").agg(F.round(F.avg("ans"), 6).alias("answerable"), F.round(F.avg("fully"), 6).alias("fully"), F.count_if((F.col("ans") == 1) & (F.col("fully") == 0)).alias("partial_only"))


@query("SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM labels GROUP BY quality, toxic")
def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT flag, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM (SELECT unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN n_chars < 500 THEN 'short' END], lambda x: x IS NOT NULL)) AS flag, n_chars FROM documents JOIN labels USING (doc_id)) GROUP BY flag")
def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    flags = decisions.all_reasons([(F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "low_quality"), (F.col("n_chars") < 500, "short")])
    return own.select(F.explode(flags).alias("flag"), "n_chars").groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


RUNS = "r AS (SELECT p_partkey AS run, p_size AS metric, p_retailprice AS latency FROM part)"


@query(f"WITH {RUNS} SELECT run, metric, latency FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.metric >= a.metric AND b.latency <= a.latency AND (b.metric > a.metric OR b.latency < a.latency))")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that no run beats, in two aggregations: the least latency of each metric, and the least of all greater metrics.

    The window holds one row for each value of the metric, not for each run.
    """
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("run"), F.col("p_size").alias("metric"), F.col("p_retailprice").alias("latency"))
    best = own.groupBy("metric").agg(F.min("latency").alias("least"))
    above = F.min("least").over(Window.orderBy(F.desc("metric")).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("above", above).where(F.col("above").isNull() | (F.col("least") < F.col("above")))
    return own.join(front, "metric").where("latency = least").select("run", "metric", "latency")


GRID = "g AS (SELECT p_size % 5 AS pool, p_partkey % 7 / 10.0::DOUBLE AS lam, round(avg(p_retailprice), 6) AS score FROM part GROUP BY ALL)"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy((F.col("p_size") % 5).alias("pool"), (F.col("p_partkey") % 7 / 10.0).alias("lam")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"))


@query(f"WITH {GRID}, n AS (SELECT *, lag(score) OVER w AS before, lead(score) OVER w AS after FROM g WINDOW w AS (PARTITION BY pool ORDER BY lam)) SELECT pool, lam, score, (coalesce(abs(before - score) <= 0.02 * score, FALSE)::INT + coalesce(abs(after - score) <= 0.02 * score, FALSE)::INT) AS flat_neighbours FROM n")
def plateau_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("pool").orderBy("lam")
    near = lambda x: F.coalesce(F.abs(x - F.col("score")) <= 0.02 * F.col("score"), F.lit(False)).cast("int")
    return grid(spark, sf).withColumn("flat_neighbours", near(F.lag("score").over(w)) + near(F.lead("score").over(w)))


@query(f"WITH {GRID} SELECT pool, lam, score FROM g ORDER BY score DESC, pool, lam LIMIT 1")
def best_config(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf).orderBy(F.desc("score"), "pool", "lam").limit(1)


@query(f"""WITH {CAND}, {SIZES}, {metrics_sql('h', 'm')}, v AS (SELECT 'hit_10' AS name, avg(hit_10) AS value FROM m UNION ALL SELECT 'mrr_10', avg(mrr_10) FROM m UNION ALL SELECT 'parse_rate', count(*) FILTER (WHERE html IS NOT NULL) / count(*)::DOUBLE FROM pages),
t AS (SELECT * FROM (VALUES ('hit_10', 0.5::DOUBLE), ('mrr_10', 0.95), ('parse_rate', 0.95), ('citation', 0.85)) x(name, least)), c AS (SELECT name, least, value, value IS NOT NULL AND value >= least AS passed FROM t LEFT JOIN v USING (name))
SELECT count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed, string_agg(CASE WHEN NOT passed THEN name END, ',' ORDER BY name) AS reasons, CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'BLOCKED' END AS verdict FROM c""")
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics against their least values; a missing metric fails."""
    own = measured(spark, sf).agg(F.avg("hit_10").alias("hit_10"), F.avg("mrr_10").alias("mrr_10")).unpivot([], ["hit_10", "mrr_10"], "name", "value")
    parsed = table(spark, sf, "pages").agg((F.count("html") / F.count("*")).alias("value")).select(F.lit("parse_rate").alias("name"), "value")
    least = spark.createDataFrame([("hit_10", 0.5), ("mrr_10", 0.95), ("parse_rate", 0.95), ("citation", 0.85)], "name string, least double")
    passed = least.join(own.unionByName(parsed), "name", "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return passed.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.nullif(F.array_join(failed, ","), F.lit("")).alias("reasons"), F.when(F.every("passed"), "PASSED").otherwise("BLOCKED").alias("verdict"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type")
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    ranks = quantiles.nearest_ranks(own, "stage", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return own.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).join(ranks, "stage")


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_linear(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    found = quantiles.linear(own, ["stage"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("stage", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id) SELECT user_id, v[(round_even((len(v) - 1) * 0.95, 0))::INT + 1] AS p95 FROM v")
def latency_rounded_index(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.rounded_ranks(table(spark, sf, "events"), ["user_id"], "value", {"p95": 0.95})
