"""A bounded recovery round: queries that a first pass doubts are routed by their verdicts to lexical search and fused with the first pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import lexical, ranking
from corvane.operators import verdicts as V
from corvane.operators.decisions import rank_delta
from corvane.sources import scratch


def frozen_state(results: DataFrame, final_k: int = 10) -> DataFrame:
    """query_id, doc_id, rank, score of a first pass's ranked results (query_id, doc_id, rank, score): what later rounds compare with and fuse."""
    return results.where(F.col("rank") <= final_k).select("query_id", "doc_id", "rank", "score")


def planned(verdicts: DataFrame, modes: tuple[str, ...] = ("oracle", "production_like")) -> DataFrame:
    """A row for each attempt of verdicts (query_id, query, wanted, titles, action), with a number of its own: attempt."""
    tries = V.attempts(verdicts, modes)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, modes)), F.col("mode")) - 1, F.lit(0))
    return tries.withColumn("attempt", F.col("query_id") * len(modes) + place)


def executed(attempts: DataFrame, frozen: DataFrame, docs: DataFrame, pool: int = 100, hybrid_k: int = 10, k_rrf: int = 60) -> tuple[DataFrame, DataFrame]:
    """(attempt, query_id, doc_id, rank) of the results after `planned` attempts, and (attempt, top_score) of their lexical lists.

    An attempt searches docs (doc_id, text) for its text and fuses what it finds with the first pass; a query that the first pass lacks has the lexical list
    alone. What is not attempted keeps the first pass.
    """
    live = attempts.where(F.col("plan").startswith("ATTEMPT")).select("attempt", "query_id", "text")
    found = scratch.written(lexical.bm25_topk(docs, live.select(F.col("attempt").alias("query_id"), "text"), pool))
    dense = frozen.join(live.select("attempt", "query_id"), "query_id")
    fused = ranking.rrf([dense.select(F.col("attempt").alias("query_id"), "doc_id", "rank"), found], k_rrf, hybrid_k)
    after = fused.withColumnRenamed("query_id", "attempt").join(live.select("attempt", "query_id"), "attempt").select("attempt", "query_id", "doc_id", "rank")
    kept = frozen.join(attempts.where(~F.col("plan").startswith("ATTEMPT")).select("attempt", "query_id"), "query_id").select("attempt", "query_id", "doc_id", "rank")
    return after.unionByName(kept), found.where("rank = 1").select(F.col("query_id").alias("attempt"), F.col("score").alias("top_score"))


def judged(attempts: DataFrame, frozen: DataFrame, after: DataFrame, gold: DataFrame, final_k: int = 10) -> DataFrame:
    """Each attempt with before and after (the first rank of a gold document, null for none), delta, skipped, recovered, regression and
    newly_entered; gold is (query_id, doc_id)."""
    first = lambda rows, by, name: rows.join(gold, ["query_id", "doc_id"], "left_semi").groupBy(by).agg(F.min("rank").alias(name))
    out = attempts.join(first(frozen, "query_id", "before"), "query_id", "left").join(first(after, "attempt", "after"), "attempt", "left")
    skipped = ~F.col("plan").startswith("ATTEMPT")

    def inside(rank: str) -> Column:
        return F.coalesce(F.col(rank) <= final_k, F.lit(False))

    return out.withColumns({
        "skipped": skipped,
        "delta": F.when(~skipped, rank_delta(F.col("before"), F.col("after"), final_k)),
        "recovered": ~skipped & ~inside("before") & inside("after"),
        "regression": ~skipped & inside("before") & ~inside("after"),
        "newly_entered": ~skipped & F.col("before").isNull() & F.col("after").isNotNull(),
    })


def run(verdicts: DataFrame, frozen: DataFrame, docs: DataFrame, gold: DataFrame, final_k: int = 10, modes: tuple[str, ...] = ("oracle", "production_like"), **search: int) -> DataFrame:
    """Attempts planned, executed and judged; docs are read once, whatever the number of queries."""
    attempts = scratch.written(planned(verdicts, modes))
    frozen = frozen_state(frozen, final_k)
    after, tops = executed(attempts, frozen, docs, **search)
    return judged(attempts, frozen, after, gold, final_k).join(tops, "attempt", "left")
