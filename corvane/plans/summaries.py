"""Queries of samples and of evaluation summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import quantiles, samples
from corvane.plans.evaluation import CAND, SIZES, measured, metrics_sql
from corvane.plans.registry import query
from corvane.plans.search import TOKENS, questions
from corvane.sources.tables import table


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY md5('r7' || doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 50")
def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents, which is what the sample has."""
    return samples.reservoir(table(spark, sf, "documents").select("doc_id", "source"), 50, "doc_id", "r7")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT conv_id, row_number() OVER (ORDER BY md5('q3' || conv_id::VARCHAR), conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE n <= 20)")
def sampled_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of twenty conversations."""
    return samples.whole_queries(table(spark, sf, "conversations").select("conv_id", "turn"), 20, "q3", "conv_id")


@query("""WITH s AS (SELECT doc_id, lang, source, round(100.0::DOUBLE + (doc_id * 37 % 101) / 10.0::DOUBLE, 9) AS s FROM documents), v AS (SELECT *, round(s - 2.5::DOUBLE * (row_number() OVER (PARTITION BY lang, source ORDER BY s DESC, doc_id) - 1), 9) AS v FROM s)
SELECT doc_id, lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY v DESC, doc_id) AS n FROM v) WHERE n <= CASE lang WHEN 'en' THEN 30 ELSE 10 END""")
def balanced_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A quota of each language, sources in balance."""
    own = table(spark, sf, "documents").select("doc_id", "lang", "source")
    score = 100.0 + (F.col("doc_id") * 37 % 101) / 10.0
    return samples.balanced(own, "lang", "source", score, F.when(F.col("lang") == "en", 30).otherwise(10), 2.5, "doc_id")


KINDS = ("plot_memory", "ambiguous", "unanswerable", "theme_question", "other")


@query(rf"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS text, list_distinct({TOKENS.format("text")}) AS words FROM conversations),
f AS (SELECT q.conv_id, q.turn, length(q.text) AS ql, length(e.text) AS el, len(list_intersect(q.words, e.words)) AS n, starts_with(e.text, q.text[1:5]) AS copies,
  contains(q.text, '찾아줘') OR contains(q.text, '뭐였') OR contains(q.text, '찾고 있어') AS seeks, ['{"','".join(KINDS)}'][q.turn % 5 + 1] AS kind
  FROM t q JOIN t e ON e.conv_id = q.conv_id AND e.turn = q.turn + 1)
SELECT conv_id, turn, round(100.0::DOUBLE + CASE WHEN ql < 18 THEN -18 WHEN ql BETWEEN 24 AND 125 THEN 8 WHEN ql > 150 THEN -12 ELSE 0 END
  + CASE WHEN el < 35 THEN -15 WHEN el BETWEEN 45 AND 220 THEN 6 ELSE 0 END + CASE WHEN kind IN ('plot_memory', 'theme_question') THEN least(n, 5) * 2.0::DOUBLE ELSE least(n, 3) * 0.8::DOUBLE END
  - CASE WHEN copies THEN 18 ELSE 0 END - CASE WHEN kind IN ('ambiguous', 'unanswerable') THEN 4 ELSE 0 END + CASE WHEN seeks THEN 2 ELSE 0 END, 9) AS quality FROM f""")
def row_qualities(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as questions and the turns that follow as their evidence."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    told = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("evidence"), F.col("words").alias("known"))
    rows = own.join(told, ["conv_id", "turn"])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("turn") % 5 + 1).cast("int"))
    copies = F.col("evidence").startswith(F.substring("text", 1, 5))
    quality = samples.row_quality(F.col("text"), F.col("evidence"), kind, F.size(F.array_intersect("words", "known")), copies)
    return rows.select("conv_id", "turn", quality.alias("quality"))


@query("""WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i < b.i WHERE round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) >= 0.92),
w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT v.i, CASE WHEN len(list_intersect(w.kept, coalesce((SELECT list(a) FROM p WHERE b = v.i), []))) = 0 THEN list_append(w.kept, v.i) ELSE w.kept END FROM w JOIN v ON v.i = w.i + 1)
SELECT vec_id FROM v WHERE list_contains((SELECT kept FROM w ORDER BY i DESC LIMIT 1), i)""")
def greedy_distinct_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The queries that stay when each in order goes for one before it whose cosine with it is 0.92 or more."""
    own = questions(spark, sf).select(F.col("query_id").alias("id"), "vector")
    return samples.greedily_kept(own.select("id"), samples.similar_pairs(own, 0.92)).select(F.col("id").alias("vec_id"))


@query(f"""WITH {CAND}, {SIZES}, {metrics_sql('h', 'm')}, t AS (SELECT m.*, ['fact', 'list', NULL][query_id // 20 % 3 + 1] AS kind FROM m) SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n, round(avg(hit_1), 6) AS hit_1, round(avg(hit_5), 6) AS hit_5, round(avg(mrr_10), 6) AS mrr_10, round(avg(hit_10 - hit_1), 6) AS uplift FROM t GROUP BY 1""")
def query_type_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("fact"), F.lit("list"), F.lit(None)), (F.floor(F.col("query_id") / 20) % 3 + 1).cast("int"))
    own = measured(spark, sf).groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind"))
    return own.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_5", "mrr_10")], F.round(F.avg(F.col("hit_10") - F.col("hit_1")), 6).alias("uplift"))


RUNS = "f AS (SELECT event_type AS mode, user_id % 2 = 0 AS first_ok, event_id % 3 = 0 AS last_ok, value AS ms, CASE WHEN event_id % 11 <> 0 THEN value % 7 END AS cost, event_id % 5 AS calls FROM events)"


@query(f"""WITH {RUNS} SELECT mode, count(*) AS n, round(avg(first_ok::INT), 6) AS before, round(avg(last_ok::INT), 6) AS after, round(avg(last_ok::INT - first_ok::INT), 6) AS gain, round(avg(cost), 6) AS cost, round(avg(calls), 6) AS calls, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, count(*) FILTER (WHERE last_ok AND NOT first_ok) AS recovered, count(*) FILTER (WHERE first_ok AND NOT last_ok) AS lost FROM f GROUP BY mode""")
def mode_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by mode: rates before and after, their mean difference, cost, calls, latencies, and what was recovered or lost."""
    e = table(spark, sf, "events")
    own = e.select(F.col("event_type").alias("mode"), (F.col("user_id") % 2 == 0).alias("a"), (F.col("event_id") % 3 == 0).alias("b"), F.col("value").alias("ms"), F.when(F.col("event_id") % 11 != 0, F.col("value") % 7).alias("cost"), (F.col("event_id") % 5).alias("calls"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    ranks = quantiles.nearest_ranks(own, "mode", "ms", {"p50": 0.5, "p95": 0.95})
    return own.groupBy("mode").agg(F.count("*").alias("n"), mean(a, "before"), mean(b, "after"), mean(b - a, "gain"), mean("cost", "cost"), mean("calls", "calls"), F.count_if(F.col("b") & ~F.col("a")).alias("recovered"), F.count_if(F.col("a") & ~F.col("b")).alias("lost")).join(ranks, "mode")


@query("""WITH f AS (SELECT conv_id, lower(text) AS t, ['the', 'zz' || (turn % 3)::VARCHAR, 'and'] AS labels FROM conversations), m AS (SELECT conv_id, len(list_filter(labels, lambda x: contains(t, x))) AS found FROM f)
SELECT conv_id, round(avg(found / 3.0::DOUBLE), 6) AS recall, round(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision FROM m GROUP BY conv_id""")
def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Labels found in answers: the share of the wanted ones, and 1 where any was found."""
    labels = F.array(F.lit("the"), F.concat(F.lit("zz"), (F.col("turn") % 3).cast("string")), F.lit("and"))
    found = F.size(F.filter(labels, lambda x: F.contains(F.lower("text"), x)))
    own = table(spark, sf, "conversations").select("conv_id", found.alias("n"))
    return own.groupBy("conv_id").agg(F.round(F.avg(F.col("n") / 3), 6).alias("recall"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("precision"))


@query("SELECT role, count(*) AS n, count(*) FILTER (WHERE refused) AS refused, round(avg(refused::INT), 6) AS rate FROM (SELECT role, contains(lower(text), 'cannot') OR contains(lower(text), 'sorry') OR contains(lower(text), 'not ') AS refused FROM conversations) GROUP BY role")
def refusal_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often questions without an answer in the corpus are refused."""
    said = F.lower("text")
    refused = F.contains(said, F.lit("cannot")) | F.contains(said, F.lit("sorry")) | F.contains(said, F.lit("not "))
    return table(spark, sf, "conversations").select("role", refused.alias("r")).groupBy("role").agg(F.count("*").alias("n"), F.count_if("r").alias("refused"), F.round(F.avg(F.col("r").cast("int")), 6).alias("rate"))


@query("""WITH f AS (SELECT l_orderkey % 300 AS query_id, l_partkey % 4 = 0 AS dense, l_suppkey % 3 = 0 AS boosted, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 0 END AS boost FROM lineitem),
q AS (SELECT query_id, bool_or(dense) AS d, bool_or(boosted) AS b, count(*) FILTER (WHERE boost > 0) AS chunks, sum(boost) FILTER (WHERE boost > 0) AS total, max(boost) FILTER (WHERE boost > 0) AS most FROM f GROUP BY query_id)
SELECT count(*) AS queries, count(*) FILTER (WHERE b AND NOT d) AS rescued, count(*) FILTER (WHERE d AND NOT b) AS regressed, sum(chunks)::BIGINT AS boosted_chunks, round(sum(total) / sum(chunks), 6) AS mean_boost, round(max(most), 6) AS max_boost FROM q""")
def boost_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What boosts rescued and lost, and how large they were where they applied."""
    boost = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(0.0)
    own = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 300).alias("query_id"), (F.col("l_partkey") % 4 == 0).alias("d"), (F.col("l_suppkey") % 3 == 0).alias("b"), boost.alias("boost"))
    on = F.col("boost") > 0
    q = own.groupBy("query_id").agg(F.bool_or("d").alias("d"), F.bool_or("b").alias("b"), F.count_if(on).alias("n"), F.sum(F.when(on, F.col("boost"))).alias("total"), F.max(F.when(on, F.col("boost"))).alias("most"))
    return q.agg(F.count("*").alias("queries"), F.count_if(F.col("b") & ~F.col("d")).alias("rescued"), F.count_if(F.col("d") & ~F.col("b")).alias("regressed"), F.sum("n").alias("boosted_chunks"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean_boost"), F.round(F.max("most"), 6).alias("max_boost"))


@query("""WITH f AS (SELECT doc_id, md5(text) AS a, md5(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS b, source FROM documents), g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE a <> b) AS changed FROM f GROUP BY source)
SELECT source, n, changed, round(changed / n::DOUBLE, 6) AS share FROM (SELECT *, row_number() OVER (ORDER BY changed DESC, source) AS r FROM g) WHERE r <= 10""")
def variant_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two exports of the same chunks paired by id, the ten sources with most changes, which is what the report has."""
    own = table(spark, sf, "documents")
    other = own.select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary")).alias("b"))
    pairs = own.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("a")).join(other, "doc_id")
    g = pairs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
    return g.orderBy(F.desc("changed"), "source").limit(10).select("source", "n", "changed", F.round(F.col("changed") / F.col("n"), 6).alias("share"))
