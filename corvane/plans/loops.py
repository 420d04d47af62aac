"""Queries of bounded loops, dispatch after commit, and variants of one pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import ranking
from corvane.operators.gold import begins, page_hit
from corvane.operators.retrieval import ranked
from corvane.operators.decisions import first_rule
from corvane.plans.gold import WANTED, wanted
from corvane.plans.registry import neighbours_sql, query
from corvane.plans.search import neighbours
from corvane.sources.tables import table

#: Fixed: what a loop may take, and the confidence at which it stops.
ITERATIONS, MILLISECONDS, TOKENS, SURE = 3, 15_000, 4_000, 0.75


@query(f"""WITH f AS (SELECT conv_id, turn, row_number() OVER w AS i, sum(length(text) * 10) OVER w AS ms, sum(length(text) // 2) OVER w AS tokens, (conv_id * 7 + turn * 13) % 100 / 100.0::DOUBLE AS sure, (conv_id + turn) % 17 = 0 AS hopeless FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, i, ms, tokens, CASE WHEN hopeless THEN 'unanswerable' WHEN sure >= {SURE} THEN 'converged' WHEN ms >= {MILLISECONDS} THEN 'time_cap' WHEN tokens >= {TOKENS} THEN 'token_cap' WHEN i >= {ITERATIONS} THEN 'iter_cap' END AS reason FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS n FROM s WHERE reason IS NOT NULL)
SELECT c.conv_id, coalesce(n.i, c.turns)::BIGINT AS iterations, coalesce(n.reason, 'ended') AS reason, coalesce(n.tokens, c.tokens)::BIGINT AS tokens FROM (SELECT conv_id, count(*) AS turns, sum(length(text) // 2) AS tokens FROM conversations GROUP BY conv_id) c LEFT JOIN n ON n.conv_id = c.conv_id AND n.n = 1""")
def loop_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Where a loop over a conversation's turns stops, and why: the first turn that any bound or verdict ends it at."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c, t, size = F.col("conv_id"), F.col("turn"), F.length("text")
    own = table(spark, sf, "conversations").select("conv_id", F.count("*").over(w).alias("i"), F.sum(size * 10).over(w).alias("ms"), F.sum(F.floor(size / 2)).over(w).alias("tokens"), ((c * 7 + t * 13) % 100 / 100.0).alias("sure"), ((c + t) % 17 == 0).alias("hopeless"))
    reason = first_rule([(F.col("hopeless"), "unanswerable"), (F.col("sure") >= SURE, "converged"), (F.col("ms") >= MILLISECONDS, "time_cap"), (F.col("tokens") >= TOKENS, "token_cap"), (F.col("i") >= ITERATIONS, "iter_cap")], None)
    own = own.withColumn("reason", reason)
    stop = F.min(F.when(F.col("reason").isNotNull(), F.struct("i", "reason", "tokens")))
    out = own.groupBy("conv_id").agg(stop.alias("s"), F.max("i").alias("turns"), F.max("tokens").alias("all"))
    return out.select("conv_id", F.coalesce("s.i", "turns").alias("iterations"), F.coalesce("s.reason", F.lit("ended")).alias("reason"), F.coalesce("s.tokens", "all").alias("tokens"))


@query("SELECT o_orderkey AS job_id, o_custkey AS owner FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def outbox_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that are committed but not dispatched yet; dispatching them again is harmless, as a message is known by its job."""
    sent = table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("job_id"))
    jobs = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"))
    return jobs.join(sent, "job_id", "left_anti")


@query(f"""WITH {neighbours_sql(40, 64, "h")}, g AS (SELECT unnest([10, 20, 40]) AS candidate_k, unnest([true, false, true]) AS use_mmr), p AS (SELECT g.*, h.*, doc_id // 4 AS page FROM h, g WHERE rank <= greatest(candidate_k, 5)),
v AS (SELECT *, CASE WHEN use_mmr THEN round(0.7::DOUBLE * score - 0.3::DOUBLE * CASE WHEN row_number() OVER (PARTITION BY query_id, candidate_k, page ORDER BY 0.7::DOUBLE * score DESC, rank) > 1 THEN 0.6::DOUBLE ELSE 0.0 END, 9) ELSE -rank END AS v FROM p)
SELECT query_id, candidate_k, doc_id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, candidate_k ORDER BY v DESC, rank) AS n FROM v) WHERE n <= 5""")
def pool_variants(spark: SparkSession, sf: str) -> DataFrame:
    """One pool cut and made diverse as each variant of the grid asks, ranks closed up."""
    pool = neighbours(spark, sf, 40).select("query_id", "doc_id", F.col("rank").alias("pos"), "score", F.floor(F.col("doc_id") / 4).alias("page"))
    out = None
    for k, diverse in ((10, True), (20, False), (40, True)):
        some = pool.where(F.col("pos") <= max(k, 5))
        part = ranking.mmr(some, 0.7, {"page": 0.6}, 5) if diverse else some.where("pos <= 5").withColumn("rank", F.col("pos"))
        part = part.select("query_id", F.lit(k).alias("candidate_k"), "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


BONUSES = (0.0, 0.02, 0.05, 0.1)


@query(f"""WITH {WANTED}, b AS (SELECT unnest({list(BONUSES)})::DOUBLE AS bonus),
v AS (SELECT bonus, query_id, page_id, path, wanted_page, wanted_path, row_number() OVER (PARTITION BY bonus, query_id ORDER BY round(score + CASE WHEN len(wanted_path) > 0 AND path[1:len(wanted_path)] = wanted_path THEN bonus ELSE 0 END, 9) DESC, rank) AS n FROM g, b),
q AS (SELECT bonus, query_id, bool_or(coalesce(page_id = wanted_page AND path[1:len(wanted_path)] = wanted_path, false)) AS hit FROM v WHERE n <= 3 AND len(wanted_path) > 0 GROUP BY ALL)
SELECT 'section_bonus_' || lpad(round(bonus * 100)::INT::VARCHAR, 3, '0') AS name, bonus, count(*) AS queries, round(avg(hit::INT), 6) AS section_hit FROM q GROUP BY bonus""")
def section_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of a section study run over nearest neighbours: what a bonus for the wanted section does to hits among the first three."""
    pool = wanted(spark, sf)
    met = (F.size("wanted_path") > 0) & begins(F.col("path"), F.col("wanted_path"))
    each = pool.select("*", F.explode(F.array(*map(F.lit, BONUSES))).alias("bonus"))
    top = ranked(each.withColumnRenamed("rank", "pos").withColumn("value", F.round(F.col("score") + F.when(met, F.col("bonus")).otherwise(0.0), 9)), ["bonus", "query_id"], F.desc("value"), "pos", k=3)
    hit = page_hit(F.col("wanted_page").cast("string"), F.col("page_id").cast("string")) & met
    own = top.where(F.size("wanted_path") > 0).groupBy("bonus", "query_id").agg(F.bool_or(hit).alias("hit"))
    name = F.concat(F.lit("section_bonus_"), F.lpad(F.round(F.col("bonus") * 100).cast("int").cast("string"), 3, "0"))
    return own.groupBy("bonus").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("section_hit")).select(name.alias("name"), "bonus", "queries", "section_hit")
