"""Queries of reports: variants against an anchor, recommendations, unions of runs, readiness and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.decisions import first_rule
from corvane.plans.evaluation import SIGNALS, SIZES, measured, metrics_sql, verdicts
from corvane.plans.registry import neighbours_sql, query
from corvane.plans.search import neighbours
from corvane.sources.tables import table


@query(f"""WITH {neighbours_sql(10, 16, "a")}, {neighbours_sql(10, 32, "b")}, {neighbours_sql(10, 64, "c")}, {SIZES}, {metrics_sql("a", "x")}, {metrics_sql("b", "y")}, {metrics_sql("c", "w")},
v AS (SELECT 'd16' AS variant, avg(hit_5) AS h, avg(mrr_10) AS m FROM x UNION ALL SELECT 'd32', avg(hit_5), avg(mrr_10) FROM y UNION ALL SELECT 'd64', avg(hit_5), avg(mrr_10) FROM w)
SELECT v.variant, round(v.h - z.h, 6) AS hit_delta, round(v.m - z.m, 6) AS mrr_delta, CASE WHEN v.m - z.m >= 0.01 THEN 'promising' WHEN v.m - z.m >= 0.005 THEN 'candidate' WHEN v.m - z.m < -0.005 THEN 'worse' ELSE 'flat' END AS grade FROM v, v z WHERE z.variant = 'd16'""")
def variant_deltas(spark: SparkSession, sf: str) -> DataFrame:
    own = None
    for dims in (16, 32, 64):
        part = measured(spark, sf, dims).agg(F.avg("hit_5").alias("h"), F.avg("mrr_10").alias("m")).withColumn("variant", F.lit(f"d{dims}"))
        own = part if own is None else own.unionByName(part)
    anchor = own.where("variant = 'd16'").select(F.col("h").alias("ah"), F.col("m").alias("am"))
    own = own.crossJoin(F.broadcast(anchor)).withColumn("d", F.col("m") - F.col("am"))  # the anchor is one row
    grade = first_rule([(F.col("d") >= 0.01, "promising"), (F.col("d") >= 0.005, "candidate"), (F.col("d") < -0.005, "worse")], "flat")
    return own.select("variant", F.round(F.col("h") - F.col("ah"), 6).alias("hit_delta"), F.round("d", 6).alias("mrr_delta"), grade.alias("grade"))


@query("""SELECT arg_min(p_partkey, [p_retailprice, p_partkey]) AS fast, arg_max(p_partkey, [p_size::DOUBLE, -p_retailprice, -p_partkey]) AS quality, arg_max(p_partkey, [p_size::DOUBLE, -p_retailprice, -p_partkey]) FILTER (WHERE p_retailprice <= 1000) AS balanced FROM part""")
def recommend_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The fastest run, the best, and the best within a latency budget; ties by latency, then id."""
    key = F.struct(F.col("p_size"), (-F.col("p_retailprice")).alias("a"), (-F.col("p_partkey")).alias("b"))
    within = F.when(F.col("p_retailprice") <= 1000, key)
    return table(spark, sf, "part").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("fast"), F.max_by("p_partkey", key).alias("quality"), F.max_by("p_partkey", within).alias("balanced"))


@query(f"""WITH {neighbours_sql(5)}, {neighbours_sql(5, 16, "g")}, u AS (SELECT query_id, doc_id, 0 AS iter, rank FROM h UNION ALL SELECT query_id, doc_id, 1, rank FROM g)
SELECT query_id, doc_id, iter, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY iter, rank) AS n FROM u) WHERE n = 1""")
def first_seen_union(spark: SparkSession, sf: str) -> DataFrame:
    """The results of two iterations, each where it came first."""
    every = neighbours(spark, sf, 5).select("query_id", "doc_id", F.lit(0).alias("iter"), "rank").unionByName(neighbours(spark, sf, 5, 16).select("query_id", "doc_id", F.lit(1).alias("iter"), "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.min(F.struct("iter", "rank")).alias("f")).select("query_id", "doc_id", "f.iter", "f.rank")


@query("SELECT track, count(*) AS n, round(avg(latency), 4) AS latency FROM (SELECT 'a' AS track, p_retailprice AS latency FROM part WHERE p_size <= 25 UNION ALL SELECT 'b', p_retailprice * 2 FROM part WHERE p_size > 10) GROUP BY track")
def sweep_union(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part")
    one = own.where("p_size <= 25").select(F.lit("a").alias("track"), F.col("p_retailprice").alias("latency"))
    two = own.where("p_size > 10").select(F.lit("b").alias("track"), (F.col("p_retailprice") * 2).alias("latency"))
    return one.unionByName(two).groupBy("track").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 4).alias("latency"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CASE WHEN l.toxic = 1 THEN 'restricted' WHEN l.toxic = 0 THEN 'open' END, d.lang) AS access FROM documents d LEFT JOIN labels l USING (doc_id)")
def backfill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return own.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.when(F.col("toxic") == 1, "restricted").when(F.col("toxic") == 0, "open"), F.col("lang")).alias("access"))


@query("SELECT has_url, has_body, secure, count(*) AS n FROM (SELECT coalesce(url, '') <> '' AS has_url, coalesce(html, '') <> '' AS has_body, starts_with(url, 'https') AS secure FROM pages) GROUP BY ALL")
def grounding_readiness(spark: SparkSession, sf: str) -> DataFrame:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    own = table(spark, sf, "pages").select(filled(F.col("url")).alias("has_url"), filled(F.col("html")).alias("has_body"), F.col("url").startswith("https").alias("secure"))
    return own.groupBy("has_url", "has_body", "secure").agg(F.count("*").alias("n"))


@query(r"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(url), '\.pdf($|[?#])') THEN 'pdf' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'anchor' WHEN ends_with(url, '/') THEN 'folder' ELSE 'page' END AS kind FROM pages) GROUP BY kind")
def file_type_rules(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    kind = first_rule([(F.lower(u).rlike(r"\.pdf($|[?#])"), "pdf"), (F.contains(u, F.lit("?")), "query"), (F.contains(u, F.lit("#")), "anchor"), (u.endswith("/"), "folder")], "page")
    return table(spark, sf, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r <= 3")
def top_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return own.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("r <= 3").drop("r")


@query(f"""{SIGNALS} SELECT CASE action WHEN 'HYBRID_RECOVERY' THEN 'hybrid' WHEN 'QUERY_REWRITE' THEN 'rewrite' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'stop' ELSE 'none' END AS plan, count(*) AS n, count(*) FILTER (WHERE gold_rank = -1) AS missed FROM c GROUP BY 1""")
def recovery_plan(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("action")
    plan = first_rule([(a == "HYBRID_RECOVERY", "hybrid"), (a == "QUERY_REWRITE", "rewrite"), (a == "INSUFFICIENT_EVIDENCE", "stop")], "none")
    return verdicts(spark, sf).groupBy(plan.alias("plan")).agg(F.count("*").alias("n"), F.count_if(F.col("gold_rank") == -1).alias("missed"))


@query(f"""WITH {neighbours_sql()}, s AS (SELECT * FROM (VALUES (0, NULL, 2), (1, 1, NULL), (2, NULL, NULL)) t(spec, parity, third))
SELECT query_id, spec, min(rank) AS first_rank, count(*) AS n FROM h JOIN s ON (parity IS NULL OR label % 2 = parity) AND (third IS NULL OR label % 3 = third) GROUP BY query_id, spec""")
def spec_match(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that fit a specification, whose empty fields fit anything; the specifications are three rows."""
    specs = spark.createDataFrame([(0, None, 2), (1, 1, None), (2, None, None)], "spec int, parity int, third int")
    fits = lambda c, v: F.col(c).isNull() | (F.col(c) == v)
    own = neighbours(spark, sf).join(F.broadcast(specs), fits("parity", F.col("label") % 2) & fits("third", F.col("label") % 3))
    return own.groupBy("query_id", "spec").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, contains(lower(p_name), lower(string_split(p_type, ' ')[1])) OR contains(lower(string_split(p_type, ' ')[1]), lower(p_name)) AS overlap FROM part")
def title_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.lower("p_name"), F.lower(F.get(F.split("p_type", " "), F.lit(0)))
    return table(spark, sf, "part").select("p_partkey", F.trim(F.regexp_replace(a, "[^a-z0-9]+", " ")).alias("title"), (F.contains(a, b) | F.contains(b, a)).alias("overlap"))
