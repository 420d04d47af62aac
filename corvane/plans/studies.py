"""Queries of studies over retrieval runs: stages, grids, loops, graded sets, before-and-after reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import embedding, metrics, quantiles, ranking, retrieval
from corvane.plans.registry import neighbours_sql, query
from corvane.plans.search import TOKENS, neighbours, passages
from corvane.sources.tables import table


@query(rf"""WITH t AS (SELECT item_id, list_filter({TOKENS.format("text")}, lambda x: length(x) >= 2 AND x NOT IN ('of','the','a','to','in','on','for','is')) AS t FROM benchmark),
u AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM t) GROUP BY item_id, w)
SELECT item_id, array_to_string(list_slice(list(w ORDER BY i), 1, 10), ' ') AS keywords FROM u GROUP BY item_id""")
def keyword_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).select(F.col("query_id").alias("item_id"), F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(f"""WITH {neighbours_sql(30)}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept_rank FROM c WHERE n <= 2)
SELECT query_id, (SELECT min(rank) FROM h WHERE h.query_id = q.query_id AND gold) AS pool_rank, (SELECT min(kept_rank) FROM k WHERE k.query_id = q.query_id AND gold) AS capped_rank,
(SELECT count(*) FROM c WHERE c.query_id = q.query_id AND gold AND n > 2) AS gold_out FROM (SELECT DISTINCT query_id FROM h) q""")
def stage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The first gold rank in the pool and after the cap, and how many gold results the cap took."""
    own = ranking.capped(neighbours(spark, sf, 30).withColumnRenamed("rank", "pos"), F.col("label"), 2)
    place = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("query_id").orderBy("pos"))
    own = own.withColumn("kept_rank", place)
    first = lambda good, c: F.min(F.when(good, F.col(c)))
    return own.groupBy("query_id").agg(first(F.col("gold"), "pos").alias("pool_rank"), first(F.col("gold") & F.col("kept"), "kept_rank").alias("capped_rank"), F.count_if(F.col("gold") & ~F.col("kept")).alias("gold_out"))


@query(f"""WITH {neighbours_sql(30)}, g AS (SELECT l, k FROM (VALUES (0.5::DOUBLE), (0.7), (0.9)) a(l), (VALUES (10), (30)) b(k)),
n AS (SELECT l, k, h.*, row_number() OVER (PARTITION BY l, k, query_id, label ORDER BY l * score DESC, rank) AS rn FROM h, g WHERE rank <= k),
v AS (SELECT l, k, query_id, gold, rank AS pos, round(l * score - (1 - l) * CASE WHEN rn > 1 THEN 0.6::DOUBLE ELSE 0 END, 9) AS value FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY l, k, query_id ORDER BY value DESC, pos) AS rank FROM v)
SELECT l, k, count(DISTINCT query_id) AS n, round(count(*) FILTER (WHERE gold AND rank <= 5) / count(DISTINCT query_id)::DOUBLE, 6) AS gold_in_5 FROM r GROUP BY l, k""")
def parameter_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every configuration of a grid over the same pool, in one plan keyed by the configuration."""
    grid = spark.createDataFrame([(w, k) for w in (0.5, 0.7, 0.9) for k in (10, 30)], "l double, k int")
    own = neighbours(spark, sf, 30).join(F.broadcast(grid), F.col("rank") <= F.col("k")).withColumnRenamed("rank", "pos")
    gain = F.col("l") * F.col("score")
    rn = F.row_number().over(Window.partitionBy("l", "k", "query_id", "label").orderBy(F.desc(gain), "pos"))
    own = own.withColumn("value", F.round(gain - (1 - F.col("l")) * F.when(rn > 1, 0.6).otherwise(0.0), 9))
    own = retrieval.ranked(own, ["l", "k", "query_id"], F.desc("value"), "pos")
    n = F.count_distinct("query_id")
    return own.groupBy("l", "k").agg(n.alias("n"), F.round(F.count_if(F.col("gold") & (F.col("rank") <= 5)) / n, 6).alias("gold_in_5"))


@query("""WITH i AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS iterations, sum(length(text)) AS cost, arg_min(length(text), turn) AS first_cost, arg_max(length(text), turn) AS last_cost FROM conversations GROUP BY conv_id)
SELECT count(*) AS n, round(avg(iterations), 6) AS mean_iterations, round(avg(cost / first_cost::DOUBLE) FILTER (WHERE first_cost > 0), 6) AS cost_multiplier, round(count(*) FILTER (WHERE first_cost < 200 AND last_cost >= 200) / nullif(count(*) FILTER (WHERE first_cost < 200), 0)::DOUBLE, 6) AS recovery_rate, round(avg(last_cost - first_cost), 6) AS delta FROM i""")
def loop_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Iterations, cost against the first turn, and recoveries of turns that began short, over whole conversations."""
    size = F.length("text")
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("iterations"), F.sum(size).alias("cost"), F.min_by(size, "turn").alias("first"), F.max_by(size, "turn").alias("last"))
    short = F.col("first") < 200
    recovered = F.count_if(short & (F.col("last") >= 200)) / F.nullif(F.count_if(short), F.lit(0))
    return own.agg(F.count("*").alias("n"), F.round(F.avg("iterations"), 6).alias("mean_iterations"), F.round(F.avg(F.when(F.col("first") > 0, F.col("cost") / F.col("first"))), 6).alias("cost_multiplier"), F.round(recovered, 6).alias("recovery_rate"), F.round(F.avg(F.col("last") - F.col("first")), 6).alias("delta"))


@query(f"""WITH {neighbours_sql()}, j AS (SELECT query_id, doc_id, CASE WHEN q_label = label THEN 2 ELSE 1 END AS score FROM h WHERE abs(q_label - label) <= 1),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM j)
SELECT query_id, array_to_string(list_sort(list(doc_id) FILTER (WHERE score = 2 OR best = 1)), ',') AS expected, array_to_string(list_sort(list(doc_id) FILTER (WHERE score = 1 AND best = 2)), ',') AS acceptable FROM m GROUP BY query_id""")
def judgements_to_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Judged results split into expected (2, or 1 where a query has no 2) and acceptable ones."""
    score = F.when(F.col("gold"), 2).otherwise(1)
    own = neighbours(spark, sf).where(F.abs(F.col("q_label") - F.col("label")) <= 1).withColumn("grade", score)
    own = own.withColumn("best", F.max("grade").over(Window.partitionBy("query_id")))
    ids = lambda good: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(good, F.col("doc_id")))), ","), F.lit(""))
    return own.groupBy("query_id").agg(ids((F.col("grade") == 2) | (F.col("best") == 1)).alias("expected"), ids((F.col("grade") == 1) & (F.col("best") == 2)).alias("acceptable"))


@query(r"""WITH c AS (SELECT lang, length(text) AS raw, length(regexp_replace(text, '[#*$%&]+', '', 'g')) AS cleaned FROM documents)
SELECT lang, CASE WHEN raw < 500 THEN 'short' WHEN raw < 5000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, sum(raw - cleaned)::BIGINT AS removed, count(*) FILTER (WHERE cleaned < raw) AS changed FROM c GROUP BY ALL""")
def cleaned_comparison(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("lang", F.length("text").alias("raw"), F.length(F.regexp_replace("text", "[#*$%&]+", "")).alias("cleaned"))
    bucket = F.when(F.col("raw") < 500, "short").when(F.col("raw") < 5000, "medium").otherwise("long")
    return own.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("raw") - F.col("cleaned")).alias("removed"), F.count_if(F.col("cleaned") < F.col("raw")).alias("changed"))


@query(f"""WITH {neighbours_sql()}, s AS (SELECT gold, count(*) AS n, round(avg(score), 6) AS mean, quantile_disc(score, 0.5) AS p50, min(score) AS least FROM h GROUP BY gold) SELECT * FROM s""")
def score_separation(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf)
    sums = own.groupBy("gold").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"))
    return sums.join(quantiles.nearest_ranks(own, "gold", "score", {"p50": 0.5}), "gold")


@query()
def hashing_embedder(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed-token vectors of all documents; SQL lacks the digest."""
    return embedding.embedded(table(spark, sf, "documents"))


@query(f"""WITH {neighbours_sql(50)}, r AS (SELECT query_id, min(rank) FILTER (WHERE gold) AS first FROM h GROUP BY query_id) SELECT k, count(*) AS n, count(*) FILTER (WHERE first <= k) AS hits, round(avg(CASE WHEN first <= k THEN 1.0::DOUBLE / first ELSE 0 END), 4) AS mrr FROM r, (VALUES (1), (5), (10), (20), (50)) x(k) GROUP BY k""")
def candidate_recall(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf, 50).groupBy("query_id").agg(metrics.first_rank().alias("first"))
    own = own.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10, 20, 50)))))
    good = F.col("first") <= F.col("k")
    return own.groupBy("k").agg(F.count("*").alias("n"), F.count_if(good).alias("hits"), F.round(F.avg(F.when(good, 1.0 / F.col("first")).otherwise(0.0)), 4).alias("mrr"))
