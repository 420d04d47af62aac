"""Queries of retrieval, fusion and diversity. Query vectors are those whose id is divisible by 20, against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical, ranking, retrieval
from corvane.plans.registry import neighbours_sql, query
from corvane.sources.tables import table

TOKENS = r"list_filter(list_transform(string_split_regex(lower(coalesce({}, '')), '[ \t\n\r\x0b\x0c]+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: x <> '')"


#: The BM25 tokens of a text in Latin script: case folding is lower case but for sharp s.
FOLDED = TOKENS.replace("coalesce({}, '')", "coalesce(replace({}, 'ß', 'ss'), '')")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector", F.col("label").alias("q_label"))


def neighbours(spark: SparkSession, sf: str, k: int = 10, dims: int = 64, within: str = "true") -> DataFrame:
    """query_id, doc_id, score, rank, q_label, label, gold (labels agree)."""
    own = vectors(spark, sf)
    top = retrieval.knn_topk(own.where(within), questions(spark, sf), k, dims)
    labels = own.select("doc_id", "label")
    out = top.join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    return out.withColumn("gold", F.col("label") == F.col("q_label"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25 = rf"""d AS (SELECT doc_id, {FOLDED.format("text")} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({FOLDED.format("text")}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)"""


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = lexical.bm25_topk(table(spark, sf, "documents"), passages(spark, sf), 10)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"))


LEXICAL = rf"""q AS (SELECT item_id AS query_id, array_to_string(list_slice({TOKENS.format("text")}, 2, 3), ' ') AS query, list_distinct(list_filter(list_slice({TOKENS.format("text")}, 2, 3), lambda x: length(x) >= 2)) AS terms FROM benchmark),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents),
m AS (SELECT query_id, doc_id, CASE WHEN starts_with(text, query) THEN 0 WHEN contains(text, query) THEN 1 ELSE 2 END AS tier FROM d JOIN q ON len(list_filter(terms, lambda t: NOT contains(text, t))) = 0)"""


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    own = passages(spark, sf).withColumn("text", F.array_join(F.slice(T.tokens(F.col("text")), 2, 2), " "))
    return own.select("query_id", "text")


@query(f"""WITH {LEXICAL} SELECT query_id, doc_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, doc_id) AS rank FROM m) WHERE rank <= 10""")
def lexical_tiered_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lexical_tiers(table(spark, sf, "documents"), phrases(spark, sf), 10)


@query(f"""WITH {LEXICAL} SELECT query_id, count(*) AS n_docs, count(*) FILTER (WHERE tier < 2) AS n_phrase FROM m GROUP BY query_id""")
def lexical_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    out = retrieval.lexical_matches(table(spark, sf, "documents"), phrases(spark, sf))
    return out.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("tier") < 2).alias("n_phrase"))


@query(f"""WITH {neighbours_sql()} SELECT query_id, doc_id, score, rank FROM h""")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(spark, sf).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {neighbours_sql(where="e.label < 5")} SELECT query_id, doc_id, score, rank FROM h""")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(spark, sf, within="label < 5").select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {neighbours_sql(20)}, f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h WHERE label < 5) SELECT * FROM f WHERE rank <= 10""")
def knn_overfetch_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = neighbours(spark, sf, 20).where("label < 5").withColumnRenamed("rank", "pos")
    return retrieval.ranked(own, "query_id", "pos", k=10).select("query_id", "doc_id", "score", "rank")


FUSED = """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM
(SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min({'list': list, 'rank': rank}) AS first FROM l GROUP BY ALL)) WHERE rank <= 10"""


@query(f"""WITH {BM25}, {neighbours_sql(100)}, l AS (SELECT query_id // 20 AS query_id, doc_id, rank, 0 AS list FROM h UNION ALL SELECT query_id, doc_id, rank, 1 FROM r WHERE rank <= 100) {FUSED}""")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and lexical results of a passage fused, a hundred of each; passage i asks with the vector 20 i too, and a vector stands for the document of its id."""
    dense = neighbours(spark, sf, 100).withColumn("query_id", F.floor(F.col("query_id") / 20))
    return ranking.rrf([dense, lexical.bm25_topk(table(spark, sf, "documents"), passages(spark, sf), 100)])


@query(f"""WITH {neighbours_sql(20)}, {neighbours_sql(20, 32, "g")}, {neighbours_sql(20, 16, "i")},
l AS (SELECT query_id, doc_id, rank, 0 AS list FROM h UNION ALL SELECT query_id, doc_id, rank, 1 FROM g UNION ALL SELECT query_id, doc_id, rank, 2 FROM i) {FUSED}""")
def multi_query_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rrf([neighbours(spark, sf, 20, d) for d in (64, 32, 16)])


POOL = neighbours_sql(30)


@query(f"""WITH {POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY 0.7::DOUBLE * score DESC, rank) AS rn FROM h),
v AS (SELECT query_id, doc_id, rank AS pos, round(0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * CASE WHEN rn > 1 THEN 0.6::DOUBLE ELSE 0 END, 9) AS value FROM n)
SELECT query_id, doc_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, pos) AS rank FROM v) WHERE rank <= 10""")
def mmr_doc(spark: SparkSession, sf: str) -> DataFrame:
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos")
    return ranking.mmr(pool, 0.7, {"label": 0.6}, 10).select("query_id", "doc_id", "value", "rank")


@query(f"""WITH {POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY 0.65::DOUBLE * score DESC, rank) AS rn, row_number() OVER (PARTITION BY query_id, label % 3 ORDER BY 0.65::DOUBLE * score DESC, rank) AS tn FROM h),
v AS (SELECT query_id, doc_id, rank AS pos, round(0.65::DOUBLE * score - (1 - 0.65::DOUBLE) * greatest(CASE WHEN rn > 1 THEN 0.6::DOUBLE ELSE 0 END, CASE WHEN tn > 1 THEN 0.4::DOUBLE ELSE 0 END), 9) AS value FROM n)
SELECT query_id, doc_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, pos) AS rank FROM v) WHERE rank <= 10""")
def mmr_doc_title(spark: SparkSession, sf: str) -> DataFrame:
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos").withColumn("title", F.col("label") % 3)
    return ranking.mmr(pool, 0.65, {"label": 0.6, "title": 0.4}, 10).select("query_id", "doc_id", "value", "rank")


CAP = f"""WITH {POOL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM h)"""


@query(f"""{CAP} SELECT query_id, doc_id, rank AS pos, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM c WHERE n <= 2""")
def cap_title(spark: SparkSession, sf: str) -> DataFrame:
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos")
    return retrieval.ranked(ranking.capped(pool, F.col("label"), 2).where("kept"), "query_id", "pos").select("query_id", "doc_id", "pos", "rank")


@query(f"""{CAP} SELECT query_id, label, count(*) AS group_size, count(*) FILTER (WHERE n > 2) AS n_out, min(rank) FILTER (WHERE n > 2) AS first_out FROM c GROUP BY query_id, label""")
def cap_out_records(spark: SparkSession, sf: str) -> DataFrame:
    own = ranking.capped(neighbours(spark, sf, 30).withColumnRenamed("rank", "pos"), F.col("label"), 2)
    return own.groupBy("query_id", "label").agg(F.count("*").alias("group_size"), F.count_if(~F.col("kept")).alias("n_out"), F.min(F.when(~F.col("kept"), F.col("pos"))).alias("first_out"))


@query(f"""WITH {POOL}, b AS (SELECT *, least(CASE WHEN label = q_label THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN label % 3 = q_label % 3 THEN 0.15::DOUBLE ELSE 0 END, 0.3::DOUBLE) AS b FROM h)
SELECT query_id, doc_id, round(b, 6) AS boost, round(score + b, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + b, 6) DESC, rank) AS rank FROM b""")
def metadata_boost(spark: SparkSession, sf: str) -> DataFrame:
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos")
    boosts = [F.when(F.col("gold"), 0.2).otherwise(0.0), F.when(F.col("label") % 3 == F.col("q_label") % 3, 0.15).otherwise(0.0)]
    return ranking.boosted(pool, boosts, 0.3).select("query_id", "doc_id", "boost", "final_score", "rank")


@query(f"""WITH {POOL}, x AS (SELECT *, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS other FROM h),
m AS (SELECT *, min(score) OVER w AS a, max(score) OVER w AS z, min(other) OVER w AS b, max(other) OVER w AS y FROM x WINDOW w AS (PARTITION BY query_id)),
v AS (SELECT query_id, doc_id, rank AS pos, round(CASE WHEN z - a <= 0 THEN 0.5 ELSE (score - a) / (z - a) END * (3::DOUBLE / 4) + CASE WHEN y - b <= 0 THEN 0.5 ELSE (other - b) / (y - b) END * (1::DOUBLE / 4), 9) AS blend FROM m)
SELECT query_id, doc_id, blend, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, pos) AS rank FROM v) WHERE rank <= 10""")
def score_blend_minmax(spark: SparkSession, sf: str) -> DataFrame:
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos").withColumn("other", (F.col("doc_id") * 7919 % 1000) / 1000.0)
    return ranking.blended(pool, {"score": 3, "other": 1}).select("query_id", "doc_id", "blend", "rank")


@query(f"""WITH {POOL}, p AS (SELECT *, [label % 2, label % 4, label] AS path, [q_label % 2, q_label % 4] AS wanted FROM h),
o AS (SELECT *, CASE WHEN path = wanted THEN 1.0 WHEN list_slice(path, 1, 2) = wanted THEN 0.5 ELSE 0.4::DOUBLE * len(list_intersect(path, wanted)) / len(list_distinct(wanted)) END::DOUBLE AS o FROM p)
SELECT query_id, doc_id, round(o, 6) AS overlap, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.1::DOUBLE * o, 9) DESC, rank) AS rank FROM o""")
def section_bonus(spark: SparkSession, sf: str) -> DataFrame:
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos")
    path, wanted = F.array(F.col("label") % 2, F.col("label") % 4, F.col("label")), F.array(F.col("q_label") % 2, F.col("q_label") % 4)
    pool = pool.withColumn("overlap", ranking.path_overlap(path, wanted)).withColumn("value", F.round(F.col("score") + 0.1 * F.col("overlap"), 9))
    return retrieval.ranked(pool, "query_id", F.desc("value"), "pos").select("query_id", "doc_id", F.round("overlap", 6).alias("overlap"), "rank")


@query(f"""WITH {POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, rank) AS n FROM h)
SELECT query_id, label AS page, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM n WHERE n = 1""")
def page_first_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunk of each page, pages by that chunk."""
    pool = neighbours(spark, sf, 30).withColumnRenamed("rank", "pos")
    best = pool.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "pos"))).where("n = 1")
    return retrieval.ranked(best, "query_id", F.desc("score"), "pos").select("query_id", F.col("label").alias("page"), "doc_id", "score", "rank")
