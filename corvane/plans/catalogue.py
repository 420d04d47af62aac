"""Queries of catalogue tables, samples and job states over the business tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import records
from corvane.operators.decisions import first_rule
from corvane.plans.registry import query
from corvane.sources.tables import table, upsert
from corvane.streaming import jobs


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return records.latest(table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def claim_candidates_semi(spark: SparkSession, sf: str) -> DataFrame:
    ready = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").join(ready, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_metadata_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open, greatest(count(*) FILTER (WHERE l_returnflag = 'R') - count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS excess FROM lineitem GROUP BY 1")
def conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_linestatus") == "O")
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count("*").alias("n"), a.alias("returned"), b.alias("open"), F.greatest(a - b, F.lit(0)).alias("excess"))


@query("SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k) AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def json_unnest_report(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


RANGES = "WITH r AS (SELECT l_orderkey AS sheet, l_linenumber AS i, l_quantity::INT AS r0, l_quantity::INT + l_linenumber AS r1, l_suppkey % 26 AS c0, l_suppkey % 26 + 2 AS c1 FROM lineitem)"


@query(f"{RANGES} SELECT a.sheet, a.i AS a, b.i AS b, (a.r0 <= b.r0 AND a.r1 >= b.r1 AND a.c0 <= b.c0 AND a.c1 >= b.c1) AS contains FROM r a JOIN r b ON a.sheet = b.sheet AND a.i < b.i WHERE a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1")
def range_overlap_match(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping rectangles of a sheet, written as A1 ranges and parsed back; a sheet is an order, which has few lines."""
    letter = lambda c: F.when(c < 26, F.char(65 + c)).otherwise(F.concat(F.lit("A"), F.char(65 + c - 26)))
    c0, r0 = F.col("l_suppkey") % 26, F.col("l_quantity").cast("int")
    text = F.concat(letter(c0), r0.cast("string"), F.lit(":"), letter(c0 + 2), (r0 + F.col("l_linenumber")).cast("string"))
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("i"), F.explode(F.array(text)).alias("text"))
    own = own.select("sheet", "i", F.explode(F.array(T.cell_range(F.col("text")))).alias("r"))  # generated rows, so that uses of r don't repeat the parsing
    a, b = own.select("sheet", F.col("i").alias("a"), F.col("r").alias("x")), own.select("sheet", F.col("i").alias("b"), F.col("r").alias("y"))
    return a.join(b, "sheet").where((F.col("a") < F.col("b")) & T.overlaps(F.col("x"), F.col("y"))).select("sheet", "a", "b", T.contains_range(F.col("x"), F.col("y")).alias("contains"))


@query("WITH new AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey + 10000000, 0 FROM customer WHERE c_nationkey = 3) SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, round(coalesce(n.c_acctbal, c.c_acctbal), 2) AS c_acctbal FROM customer c FULL JOIN new n USING (c_custkey)")
def upsert_changes(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer")
    new = own.where("c_mktsegment = 'BUILDING'").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = new.unionByName(own.where("c_nationkey = 3").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return upsert(own.select("c_custkey", "c_acctbal"), new, ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("WITH new AS (SELECT doc_id + 5 AS doc_id, md5(text) AS h FROM documents), old AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT change, count(*) AS n FROM (SELECT CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'gone' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new USING (doc_id)) GROUP BY change")
def incremental_changes(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return records.change_kinds(own, own.withColumn("doc_id", F.col("doc_id") + 5), "doc_id", "h").groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1000 + row_number() OVER (ORDER BY doc_id // 500, doc_id) - 1 AS row_id FROM documents")
def append_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id")
    return records.with_next_ids(own, 1000, F.floor(F.col("doc_id") / 500), "doc_id").select("doc_id", "row_id")


@query("SELECT conv_id, count(*) AS n_hits, round(avg(length(text)), 4) AS mean_chars, count(*) FILTER (WHERE role = 'user') > 1 AS rewritten, min(turn) AS first FROM conversations GROUP BY conv_id")
def audit_runs_hits(spark: SparkSession, sf: str) -> DataFrame:
    """One run for each conversation with its ranked hits counted."""
    own = table(spark, sf, "conversations")
    return own.groupBy("conv_id").agg(F.count("*").alias("n_hits"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), (F.count_if(F.col("role") == "user") > 1).alias("rewritten"), F.min("turn").alias("first"))


@query("SELECT doc_id, lang, quality FROM (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5(concat('s1', doc_id::VARCHAR)), doc_id) AS n FROM documents JOIN labels USING (doc_id)) WHERE n <= 20")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return records.stratified(own, ["lang", "quality"], 20, "doc_id", "s1")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 5")
def cap_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return records.stratified(table(spark, sf, "documents").select("doc_id", "source"), ["source"], 5, "doc_id")


@query("WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM documents) SELECT doc_id, source FROM n WHERE list_contains(list_transform(range(7), lambda k: least(round_even(k * size / 7::DOUBLE, 0), size - 1)::BIGINT), i)")
def evenly_spaced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return records.evenly_spaced(table(spark, sf, "documents").select("doc_id", "source"), "source", 7, "doc_id")


@query("WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents WHERE trim(text) <> '') SELECT doc_id FROM n WHERE n = 1")
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each collapsed, lower-cased text; the text's digest is what is shuffled."""
    key = F.md5(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))).cast("binary"))
    own = table(spark, sf, "documents").where(F.trim("text") != "").select("doc_id", key.alias("k"))
    return own.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT n_name, r_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance, count(*) FILTER (WHERE c_acctbal < 0) AS overdrawn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def bucket_report(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT doc_id, indexable, reason FROM (SELECT d.doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN l.doc_id IS NULL THEN 'no_metadata' WHEN toxic = 1 THEN 'blocked' WHEN n_chars > 20000 THEN 'too_long' ELSE 'ok' END AS reason, reason = 'ok' AS indexable FROM documents d LEFT JOIN labels l USING (doc_id))")
def embeddability(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    reason = first_rule([(F.trim("text") == "", "blank"), (F.col("known").isNull(), "no_metadata"), (F.col("toxic") == 1, "blocked"), (F.col("n_chars") > 20000, "too_long")], "ok")
    return own.select("doc_id", (reason == "ok").alias("indexable"), reason.alias("reason"))


@query("SELECT doc_id, row_errors FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars <> length(text) THEN 'n_chars' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS row_errors FROM documents) WHERE row_errors <> ''")
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    twice = F.count("*").over(Window.partitionBy("doc_id")) > 1
    own = table(spark, sf, "documents").withColumn("twice", twice)
    errors = F.array_compact(F.array(F.when(F.col("n_chars") != F.length("text"), F.lit("n_chars")), F.when(~F.col("lang").isin("en", "de", "fr"), F.lit("lang")), F.when(F.col("twice"), F.lit("duplicate"))))
    return own.select("doc_id", F.array_join(errors, ",").alias("row_errors")).where("row_errors <> ''")


STATES = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END"


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    state = first_rule([(F.col("event_type") == "view", "RUNNING"), (F.col("event_type") == "purchase", "SUCCEEDED"), (F.col("event_type") == "error", "FAILED")], "QUEUED")
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, {STATES} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
m AS (SELECT * FROM (VALUES ('PENDING', 'QUEUED'), ('QUEUED', 'RUNNING'), ('QUEUED', 'FAILED'), ('RUNNING', 'SUCCEEDED'), ('RUNNING', 'FAILED'), ('RUNNING', 'QUEUED')) t(a, b)),
w AS (SELECT job_id, 0::BIGINT AS i, 'PENDING' AS state, 0::BIGINT AS accepted FROM (SELECT DISTINCT job_id FROM e) UNION ALL
  SELECT w.job_id, e.i, CASE WHEN m.a IS NULL THEN w.state ELSE e.state END, w.accepted + (m.a IS NOT NULL)::BIGINT FROM w JOIN e ON e.job_id = w.job_id AND e.i = w.i + 1 LEFT JOIN m ON m.a = w.state AND m.b = e.state)
SELECT job_id, arg_max(state, i) AS state, max(accepted) AS accepted, max(i) - max(accepted) AS rejected FROM w GROUP BY job_id""")
def job_state_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The state machine over each job's events in order; the stream of the same name keeps it up to date."""
    return jobs.replayed(job_events(spark, sf))


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def event_dedup(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"))
    return own.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = own.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("SELECT job_id, stale FROM (SELECT user_id AS job_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL '6 hours' AS stale FROM events WHERE event_type = 'view' GROUP BY user_id)")
def stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events")
    last = own.where("event_type = 'view'").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("at"))
    return last.crossJoin(F.broadcast(own.agg(F.max("ts").alias("now")))).select("job_id", (F.col("at") < F.col("now") - F.expr("INTERVAL '6' HOUR")).alias("stale"))  # now is one row
