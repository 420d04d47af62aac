"""Queries of index versions, row lookups, claims and leases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import indexes as I
from corvane.plans.registry import neighbours_sql, query
from corvane.plans.search import neighbours
from corvane.sources.tables import table


def versions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.concat(F.lit("v"), n.cast("string")).alias("version"), F.lit("STAGED").alias("status"), (n == 3).alias("active"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("string").alias("eval"), n.cast("long").alias("at"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    evals = table(spark, sf, "nation").where(n % 4 != 0).select(F.concat(F.lit("v"), n.cast("string")).alias("version"), F.concat(F.lit("e"), n.cast("string")).alias("eval"), (n % 3 != 0).alias("passed"))
    return I.with_eval(versions(spark, sf), evals)


JUDGED = "j AS (SELECT 'v' || n_nationkey::VARCHAR AS version, CASE WHEN n_nationkey % 4 = 0 THEN 'STAGED' WHEN n_nationkey % 3 <> 0 THEN 'EVAL_PASSED' ELSE 'EVAL_FAILED' END AS status, n_nationkey = 3 AS active, CASE WHEN n_nationkey % 4 <> 0 THEN 'e' || n_nationkey::VARCHAR END AS eval, n_nationkey::BIGINT AS \"at\" FROM nation)"


@query(f"WITH {JUDGED} SELECT version, CASE version WHEN 'v7' THEN 'PROMOTED' WHEN 'v3' THEN 'RETIRED' ELSE status END AS status, version = 'v7' AS active, CASE WHEN version = 'v7' THEN 'v3' END AS previous, eval, CASE WHEN version = 'v7' THEN 100 ELSE \"at\" END AS \"at\" FROM j")
def index_promotion(spark: SparkSession, sf: str) -> DataFrame:
    return I.promoted(judged(spark, sf), "v7", 100)


@query(f"WITH {JUDGED} SELECT version, CASE version WHEN 'v7' THEN 'ROLLED_BACK' WHEN 'v3' THEN 'PROMOTED' ELSE status END AS status, version = 'v3' AS active, CASE WHEN version = 'v7' THEN 'v3' END AS previous, eval, CASE WHEN version = 'v7' THEN 200 ELSE \"at\" END AS \"at\" FROM j")
def index_rollback(spark: SparkSession, sf: str) -> DataFrame:
    return I.rolled_back(I.promoted(judged(spark, sf), "v7", 100), "v7", 200)


@query(f"""WITH {neighbours_sql(10, 64, "h")} SELECT query_id, doc_id AS row_id, 'c' || doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h WHERE doc_id % 3 <> 0""")
def chunks_by_row(spark: SparkSession, sf: str) -> DataFrame:
    """Hits looked up among a version's chunks, those that it lacks left out and ranks closed up."""
    i = F.col("vec_id")
    every = table(spark, sf, "embeddings").select(i.alias("row_id"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.when(i % 3 != 0, "new").otherwise("old").alias("index_version"))
    hits = neighbours(spark, sf, 10).select("query_id", "rank", F.col("doc_id").alias("row_id"))
    return I.lookup(every, hits, "new").select("query_id", "row_id", "chunk_id", "rank")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS chunks, 'v' || max(n_nationkey)::VARCHAR AS last_version, max(n_nationkey)::BIGINT AS last_at FROM nation")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.stats(table(spark, sf, "documents"), table(spark, sf, "conversations"), versions(spark, sf))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS index_version FROM documents WHERE doc_id % 4 = 0 OR doc_id % 2 = 1")
def replaced_version(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of a version replaced by others at once."""
    own = table(spark, sf, "documents").select("doc_id")
    old = own.select("doc_id", F.when(F.col("doc_id") % 2 == 1, "old").otherwise("new").alias("index_version"))
    return I.replaced(old, own.where("doc_id % 4 = 0"), "new")


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_linenumber % 3 AS t, ['workbook_summary', 'table', 'row_group', 'paragraph'][l_suppkey % 4 + 1] AS chunk, l_partkey % 2 = 0 AS sheet, l_partkey % 3 = 0 AS cells, l_partkey % 5 <> 0 AS page, l_partkey % 7 <> 0 AS box, l_partkey % 11 = 0 AS ocr, l_partkey % 13 = 0 AS sure FROM lineitem)
SELECT k, CASE WHEN t = 0 AND chunk <> 'workbook_summary' AND NOT sheet THEN 'sheet_name' WHEN t = 0 AND chunk IN ('table', 'row_group') AND NOT cells THEN 'cell_range' WHEN t = 1 AND NOT page THEN 'page' WHEN t = 1 AND chunk = 'paragraph' AND NOT box THEN 'bbox' WHEN t = 1 AND ocr AND NOT sure THEN 'ocr_confidence' END AS gap FROM f""")
def location_gaps(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey")
    place = F.struct(F.when(p % 2 == 0, "s").otherwise(" ").alias("sheet"), F.when(p % 3 == 0, "A1").alias("cells"), F.when(p % 5 != 0, 1).alias("page_no"), F.lit(None).cast("string").alias("page_label"), F.lit(None).cast("int").alias("physical"), F.when(p % 7 != 0, F.array(F.lit(1.0))).alias("box"), (p % 11 == 0).alias("ocr"), F.when(p % 13 == 0, 0.5).alias("sure"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "XLSX ").when(F.col("l_linenumber") % 3 == 1, "pdf").otherwise("text")
    chunk = F.element_at(F.array(*map(F.lit, ("workbook_summary", "table", "row_group", "paragraph"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    own = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), kind.alias("t"), chunk.alias("c"), place.alias("p"))
    return own.select("k", I.location_gap(F.col("t"), F.col("c"), F.col("p")).alias("gap"))


#: Orders as units: their state, priority, date and price say what is known of a unit.
UNITS = """u AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'EMBEDDING' ELSE 'EMBEDDED' END AS status, o_orderpriority <> '5-LOW' AS ready,
  epoch(o_orderdate)::BIGINT AS claimed_at, epoch(o_orderdate)::BIGINT AS "at", CASE WHEN o_totalprice < 60000 THEN 'blank' END AS reason FROM orders)"""
NOW = 883612800


def units(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_timestamp("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "EMBEDDING").otherwise("EMBEDDED")
    ready, reason = F.col("o_orderpriority") != "5-LOW", F.when(F.col("o_totalprice") < 60000, "blank")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), ready.alias("source_ready"), at.alias("claimed_at"), at.alias("at"), reason.alias("reason"))


@query(f"""WITH {UNITS}, p AS (SELECT id, reason, 0 AS turn, "at" AS since FROM u WHERE ready AND status = 'PENDING' ORDER BY "at", id LIMIT 400),
s AS (SELECT id, reason, 1 AS turn, claimed_at AS since FROM u WHERE ready AND status = 'EMBEDDING' AND claimed_at < {NOW - 900} ORDER BY claimed_at, id LIMIT greatest(0, 200 - (SELECT count(*) FROM p))),
v AS (SELECT *, row_number() OVER (ORDER BY turn, since, id) AS n FROM (FROM p UNION ALL FROM s)),
e AS (SELECT v.*, (SELECT count(*) FROM v w WHERE w.n < v.n AND w.reason IS NULL) AS before FROM v)
SELECT id, CASE WHEN reason IS NULL THEN 'claimed' ELSE 'skipped' END AS result, CASE WHEN reason IS NULL THEN 'w:' || id::VARCHAR END AS token, reason FROM e WHERE before < 200""")
def claimed_units(spark: SparkSession, sf: str) -> DataFrame:
    """A claim of 200 units, which is what a claim takes: pending ones first, then claims of over fifteen minutes ago."""
    return I.claimed(units(spark, sf), NOW, 900)


@query(f"""WITH {UNITS} SELECT id, CASE WHEN id % 3 = 0 AND id % 7 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'EMBEDDED' ELSE 'PENDING' END ELSE status END AS status, CASE WHEN id % 3 <> 0 THEN NULL WHEN id % 7 = 0 THEN 'not_applied' WHEN id % 2 = 0 THEN 'applied' ELSE 'stale' END AS outcome FROM u""")
def finished_units(spark: SparkSession, sf: str) -> DataFrame:
    own = units(spark, sf).withColumn("token", F.lit("t")).withColumn("hash", F.lit("h"))
    k = F.col("id")
    results = own.where(k % 3 == 0).select("id", F.when(k % 7 == 0, "x").otherwise("t").alias("token"), F.when(k % 2 == 0, "h").otherwise("g").alias("hash"))
    return I.finished(own, results)


@query("""WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 5 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'z' END END AS held, o_orderkey % 200 AS expires FROM orders WHERE o_orderkey % 11 <> 0),
q AS (SELECT o_orderkey AS job_id, unnest(['a', 'b']) AS token FROM orders)
SELECT job_id, token, CASE WHEN result = 'CLAIMED' THEN 160 END AS expires, result FROM (SELECT job_id, token, CASE WHEN status IS NULL THEN 'JOB_NOT_FOUND' WHEN status IN ('SUCCEEDED', 'FAILED') THEN 'JOB_TERMINAL' WHEN held = token THEN 'CLAIMED' WHEN held IS NOT NULL AND expires >= 100 THEN 'ALREADY_CLAIMED' WHEN token = 'a' THEN 'CLAIMED' ELSE 'CLAIM_RACE' END AS result FROM q LEFT JOIN j USING (job_id))""")
def job_leases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = table(spark, sf, "orders")
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "QUEUED", "RUNNING", "SUCCEEDED", "FAILED"))), (k % 5 + 1).cast("int"))
    jobs = own.where(k % 11 != 0).select(k.alias("job_id"), status.alias("status"), F.when(k % 5 == 2, F.when(k % 2 == 0, "a").otherwise("z")).alias("token"), (k % 200).alias("expires"))
    requests = own.select(k.alias("job_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("token"))
    return I.leased(jobs, requests, 100, 60)
