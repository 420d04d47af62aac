"""Queries of gold pages and sections over nearest neighbours: a page is four vectors, a path a vector's label and remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gold as G
from corvane.operators import ranking
from corvane.plans.registry import neighbours_sql, query
from corvane.plans.search import neighbours
from corvane.sources.tables import table

NEAR = neighbours_sql(10, 64, "h")
#: Adds the wanted page, path and chunk: those of the neighbour at a rank that the query's number gives, none for a third of them.
WANTED = f"""{NEAR}, p AS (SELECT *, doc_id // 4 AS page_id, ['l' || label::VARCHAR, 'm' || (doc_id % 3)::VARCHAR] AS path FROM h),
w AS (SELECT query_id, page_id AS wanted_page, CASE WHEN query_id % 7 = 0 THEN [] WHEN query_id % 2 = 0 THEN path[1:1] ELSE path END AS wanted_path, CASE WHEN query_id % 9 <> 0 THEN doc_id END AS wanted_chunk FROM p WHERE rank = 1 + (query_id // 20) % 14),
g AS (SELECT p.*, wanted_page, wanted_path, wanted_chunk FROM p LEFT JOIN w USING (query_id))"""


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    path = F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))
    p = neighbours(spark, sf, 10).select("query_id", "doc_id", "rank", "score", "label", F.floor(F.col("doc_id") / 4).alias("page_id"), path.alias("path"))
    q = F.col("query_id")
    cut = F.when(q % 7 == 0, F.array().cast("array<string>")).when(q % 2 == 0, F.slice("path", 1, 1)).otherwise(F.col("path"))
    w = p.where(F.col("rank") == 1 + F.floor(q / 20) % 14).select("query_id", F.col("page_id").alias("wanted_page"), cut.alias("wanted_path"), F.when(q % 9 != 0, F.col("doc_id")).alias("wanted_chunk"))
    return p.join(w, "query_id", "left")


@query(f"""WITH {WANTED}, m AS (SELECT query_id, min(rank) FILTER (WHERE page_id = wanted_page) AS first, CASE WHEN max(len(wanted_path)) > 0 THEN max(CASE WHEN rank <= 5 AND page_id = wanted_page AND path[1:len(wanted_path)] = wanted_path THEN 1 ELSE 0 END) END AS section_hit,
CASE WHEN max(wanted_chunk) IS NOT NULL THEN max(CASE WHEN rank <= 5 AND doc_id = wanted_chunk THEN 1 ELSE 0 END) END AS chunk_hit FROM g GROUP BY query_id)
SELECT query_id, first, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(1.0::DOUBLE / log2(first + 1), 0), 6) AS ndcg, section_hit, chunk_hit FROM m""")
def page_section_metrics(spark: SparkSession, sf: str) -> DataFrame:
    own = wanted(spark, sf).groupBy("query_id").agg(G.first_page_rank(10).alias("first"), G.path_hit(5).alias("section_hit"), G.chunk_hit(5, "doc_id").alias("chunk_hit"))
    return own.select("query_id", "first", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(1.0 / F.log2(F.col("first") + 1.0), F.lit(0.0)), 6).alias("ndcg"), "section_hit", "chunk_hit")


@query(f"""WITH {WANTED}, s AS (SELECT query_id, rank, page_id = wanted_page AS ph, array_to_string(path, ' > ') AS got, array_to_string(wanted_path, ' > ') AS want FROM g)
SELECT query_id, rank, coalesce(ph, false) AS page_hit, coalesce(ph AND want <> '' AND (got = want OR starts_with(got, want || ' > ')), false) AS section_hit FROM s""")
def page_section_hits(spark: SparkSession, sf: str) -> DataFrame:
    page = G.page_hit(F.col("wanted_page").cast("string"), F.col("page_id").cast("string"))
    return wanted(spark, sf).select("query_id", "rank", page.alias("page_hit"), G.section_hit(page, G.joined_path(F.col("wanted_path")), G.joined_path(F.col("path"))).alias("section_hit"))


LABELS = f"""{WANTED}, a AS (SELECT ['full', 'half'][v + 1] AS variant, query_id, rank, (doc_id * 7 + v) % 4 AS label, coalesce(page_id = wanted_page, false) AS page_hit, coalesce(page_id = wanted_page AND path[1:greatest(len(wanted_path), 1)] = wanted_path, false) AS section_hit, list_filter([CASE WHEN page_id <> wanted_page THEN 'wrong_page' END, CASE WHEN doc_id % 5 = 0 THEN 'evidence_too_noisy' END, CASE WHEN page_id = wanted_page AND doc_id % 2 = 0 THEN 'needs_subpage' END], lambda x: x IS NOT NULL) AS flags FROM g, (SELECT unnest([0, 1]) AS v))"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    page = G.page_hit(F.col("wanted_page").cast("string"), F.col("page_id").cast("string"))
    each = wanted(spark, sf).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    even = (F.col("page_id") == F.col("wanted_page")) & (F.col("doc_id") % 2 == 0)
    flags = F.array_compact(F.array(F.when(F.col("page_id") != F.col("wanted_page"), "wrong_page"), F.when(F.col("doc_id") % 5 == 0, "evidence_too_noisy"), F.when(even, "needs_subpage")))
    return each.select(F.when(F.col("v") == 0, "full").otherwise("half").alias("variant"), "query_id", "rank", ((F.col("doc_id") * 7 + F.col("v")) % 4).alias("label"), page.alias("page_hit"), (page & G.begins(F.col("path"), F.col("wanted_path"))).alias("section_hit"), "doc_id", flags.alias("flags"))


AT = [(k, name, n) for k in (1, 3, 5) for name, n in (("answerable", 2), ("fully", 3))]


@query(f"""WITH {LABELS}, q AS (SELECT variant, query_id, count(*) AS n, {", ".join(f"bool_or(rank <= {k} AND label >= {n}) AS {name}_{k}" for k, name, n in AT)},
  bool_or(rank <= 5 AND page_hit) AS page, bool_or(rank <= 5 AND section_hit) AS section FROM a GROUP BY ALL),
c AS (SELECT variant, flag, count(*) AS n FROM (SELECT variant, unnest(flags) AS flag FROM a WHERE rank <= 5) GROUP BY ALL)
SELECT variant, count(*) AS queries, sum(n)::BIGINT AS rows, {", ".join(f"round(avg({name}_{k}::INT), 6) AS {name}_{k}" for k, name, n in AT)},
  count(*) FILTER (WHERE page AND NOT answerable_5) AS page_only, count(*) FILTER (WHERE answerable_5 AND NOT section) AS off_section,
  {", ".join(f"coalesce((SELECT n FROM c WHERE c.variant = q.variant AND flag = '{x}'), 0) AS {x}" for x in G.FLAGS)} FROM q GROUP BY variant""")
def answerability_variants(spark: SparkSession, sf: str) -> DataFrame:
    return G.answerable(labelled(spark, sf))


@query(f"""WITH {LABELS}, b AS (SELECT query_id, k, max(label) AS label, md5(string_agg('[' || rank::VARCHAR || '] d' || doc_id::VARCHAR || chr(10) || 't' || label::VARCHAR, chr(10) || chr(10) ORDER BY rank)) AS digest FROM (SELECT a.*, h.doc_id FROM a JOIN h USING (query_id, rank) WHERE variant = 'full'), (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL) SELECT query_id, k, label, digest FROM b""")
def context_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """The rendered context of the first results, by its digest, and the best label in it."""
    rows = labelled(spark, sf).where("variant = 'full'").select("query_id", "rank", "label", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("text"))
    return G.bundles(rows).select("query_id", "k", "label", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {LABELS}, b AS (SELECT query_id, k, max(label) AS label FROM a, (SELECT unnest([1, 3, 5]) AS k) WHERE variant = 'full' AND rank <= k GROUP BY ALL) SELECT k, count(*) AS queries, round(avg(CASE WHEN label >= 2 THEN 1 ELSE 0 END), 6) AS answerable, round(avg(CASE WHEN label = 3 THEN 1 ELSE 0 END), 6) AS fully FROM b GROUP BY k""")
def bundle_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).where("variant = 'full'").select("query_id", "rank", "label", F.lit("").alias("title"), F.lit("").alias("text"))
    return G.bundles(rows).groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg((F.col("label") >= 2).cast("int")), 6).alias("answerable"), F.round(F.avg((F.col("label") == 3).cast("int")), 6).alias("fully"))


def words(spark: SparkSession, sf: str) -> Column:
    q = F.col("query_id")
    return F.array(F.concat(F.lit("m"), (F.floor(q / 20) % 3).cast("string")), F.concat(F.lit("l"), (q % 4).cast("string")))


@query(f"""WITH {NEAR}, c AS (SELECT vec_id AS other, vec_id // 4 AS page_id, ['l' || label::VARCHAR, 'm' || (vec_id % 3)::VARCHAR] AS path FROM embeddings),
p AS (SELECT query_id, rank, doc_id, doc_id // 4 AS page_id, ['m' || (query_id // 20 % 3)::VARCHAR, 'l' || (query_id % 4)::VARCHAR] AS words FROM h WHERE rank <= 5),
s AS (SELECT p.query_id, p.rank, p.page_id, p.doc_id, c.other, len(list_filter(c.path, lambda x: list_contains(words, x))) / 2.0::DOUBLE AS share FROM p JOIN c USING (page_id)),
o AS (SELECT query_id, rank, share AS own FROM s WHERE other = doc_id), b AS (SELECT query_id, rank, arg_max(other, share * 1000000000 - other) AS other, max(share) AS share FROM s GROUP BY ALL)
SELECT p.query_id, p.rank, p.page_id, CASE WHEN b.share > own + 1e-9 THEN b.other ELSE p.doc_id END AS chunk_id FROM p JOIN b USING (query_id, rank) JOIN o USING (query_id, rank)""")
def same_page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each result's page gives the chunk whose section the query names best."""
    path = lambda label, i: F.array(F.concat(F.lit("l"), F.col(label).cast("string")), F.concat(F.lit("m"), (F.col(i) % 3).cast("string")))
    chunks = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("page_id"), F.col("vec_id").alias("place"), F.col("vec_id").alias("chunk_id"), path("label", "vec_id").alias("path"))
    picked = neighbours(spark, sf, 5).select("query_id", "rank", F.floor(F.col("doc_id") / 4).alias("page_id"), F.col("doc_id").alias("chunk_id"), path("label", "doc_id").alias("path"), words(spark, sf).alias("words"))
    return G.best_of_page(picked, chunks)


@query(f"""WITH {WANTED}, o AS (SELECT query_id, doc_id, rank, score, CASE WHEN len(coalesce(wanted_path, [])) = 0 THEN 0.0 WHEN path = wanted_path THEN 1.0 WHEN path[1:len(wanted_path)] = wanted_path THEN 0.5 WHEN path[len(path)] = wanted_path[len(wanted_path)] THEN 0.4 ELSE 0.0 END::DOUBLE AS part FROM g)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.05::DOUBLE * part, 9) DESC, rank) AS rank FROM o""")
def section_bonus_ranks(spark: SparkSession, sf: str) -> DataFrame:
    own = wanted(spark, sf).withColumn("wanted_path", F.coalesce("wanted_path", F.array().cast("array<string>")))
    own = own.withColumn("part", G.leaf_overlap(F.col("path"), F.col("wanted_path")))
    return ranking.ranked(own.withColumn("v", F.round(F.col("score") + 0.05 * F.col("part"), 9)).withColumnRenamed("rank", "pos"), "query_id", F.desc("v"), "pos").select("query_id", "doc_id", "rank")


@query(f"""WITH {NEAR}, s AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 37 % 101) / 100.0::DOUBLE END AS s FROM h), r AS (SELECT query_id, doc_id, gold, rank AS rank_before, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS rank FROM s)
SELECT query_id, doc_id, rank_before, rank, gold, gold AND rank > rank_before AS demoted FROM r WHERE rank <= 5""")
def reranked_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool by a scorer's figures, results that it can't score after the others in their old order."""
    score = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") * 37 % 101) / 100.0)
    out = G.reranked(neighbours(spark, sf, 10), score, 5)
    return out.select("query_id", "doc_id", "rank_before", "rank", "gold", (F.col("gold") & (F.col("rank") > F.col("rank_before"))).alias("demoted"))


@query(f"""WITH {NEAR}, s AS (SELECT *, (doc_id * 37 % 101) / 100.0::DOUBLE AS s FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS after FROM s)
SELECT count(*) FILTER (WHERE gold) AS gold_in_pool, count(*) FILTER (WHERE gold AND after > rank) AS demoted, count(*) FILTER (WHERE gold AND after < rank) AS raised, count(DISTINCT query_id) FILTER (WHERE gold) AS queries FROM r""")
def rerank_gold_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = G.reranked(neighbours(spark, sf, 10), (F.col("doc_id") * 37 % 101) / 100.0, 10)
    moved = F.col("rank") - F.col("rank_before")
    return out.agg(F.count_if("gold").alias("gold_in_pool"), F.count_if(F.col("gold") & (moved > 0)).alias("demoted"), F.count_if(F.col("gold") & (moved < 0)).alias("raised"), F.count_distinct(F.when(F.col("gold"), F.col("query_id"))).alias("queries"))


@query(f"""WITH {NEAR}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label, doc_id % 3 ORDER BY rank) AS n, count(*) OVER (PARTITION BY query_id, label, doc_id % 3) AS size FROM h) SELECT query_id, doc_id, rank, n <= 2 AS kept, size FROM c""")
def cap_section_path(spark: SparkSession, sf: str) -> DataFrame:
    """Two results of a section at most, with the group's size; dropped ones are marked."""
    key = F.concat_ws("|", F.col("label").cast("string"), (F.col("doc_id") % 3).cast("string"))
    from pyspark.sql import Window

    own = neighbours(spark, sf, 10).withColumn("k", key)
    return ranking.capped(own, F.col("k"), 2, pos="rank").select("query_id", "doc_id", "rank", "kept", F.count("*").over(Window.partitionBy("query_id", "k")).alias("size"))


@query(f"""WITH {neighbours_sql(10, 64, "t")}, {neighbours_sql(10, 32, "i")}, u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS src, rank FROM t UNION ALL SELECT query_id, doc_id + 1000000000, 1.0::DOUBLE / (60 + rank), 1, rank FROM i WHERE rank <= 5)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(s), 9) AS score, min(src * 1000 + rank) AS first FROM u GROUP BY ALL) QUALIFY rank <= 10""")
def cross_modal_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Text results fused with those of a second modality, whose ids are a space of their own."""
    image = neighbours(spark, sf, 5, 32).withColumn("doc_id", F.col("doc_id") + 1000000000)
    return ranking.rrf([neighbours(spark, sf, 10), image]).select("query_id", "doc_id", "score", "rank")


PLACES = """p AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_linenumber % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'pdf' ELSE 'other' END AS kind, l_orderkey % 13 AS o, l_partkey % 11 AS r, ['exact_match', 'contains_expected', 'overlaps_expected', 'none'][l_suppkey % 4 + 1] AS policy, l_partkey % 5 AS pg, l_suppkey % 5 AS gpg FROM lineitem),
r AS (SELECT *, o + 1 AS a0, o + 3 AS a1, r + 1 AS b0, r + 1 + pg AS b1 FROM p)"""


@query(f"""WITH {PLACES} SELECT k, CASE kind WHEN 'xlsx' THEN (o % 4 = 0 OR o % 4 = r % 3) AND CASE policy WHEN 'none' THEN true WHEN 'exact_match' THEN a0 = b0 AND a1 = b1 WHEN 'contains_expected' THEN b0 <= a0 AND b1 >= a1 ELSE a0 <= b1 AND b0 <= a1 END
WHEN 'pdf' THEN (o % 3 = 0 OR pg = gpg) AND (r % 2 = 0 OR (o * 10 <= r * 10 + 25 AND r * 10 <= o * 10 + 25)) ELSE true END AS met FROM r""")
def location_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and found places in sheets and pages; a wish that is left empty is met by anything."""
    col = F.col
    o, r = col("l_orderkey") % 13, col("l_partkey") % 11
    pg, gpg = col("l_partkey") % 5, col("l_suppkey") % 5
    cells = lambda a, b: F.concat(F.lit("A"), a.cast("string"), F.lit(":A"), b.cast("string"))
    box = lambda x: F.array(*[y.cast("double") for y in (x * 10, F.lit(0), x * 10 + 25, F.lit(9))])
    none = F.lit(None)
    sheet = lambda x: F.concat(F.lit("s"), x.cast("string"))
    want = F.struct(F.when(col("l_linenumber") % 3 == 0, "xlsx").when(col("l_linenumber") % 3 == 1, "pdf").otherwise("other").alias("kind"), F.when(o % 4 == 0, "").otherwise(sheet(o % 4)).alias("sheet"), F.lit("").alias("tbl"), cells(o + 1, o + 3).alias("cells"), F.element_at(F.array(*map(F.lit, ("exact_match", "contains_expected", "overlaps_expected", "none"))), (col("l_suppkey") % 4 + 1).cast("int")).alias("policy"), none.cast("bigint").alias("physical"), F.when(o % 3 != 0, pg).alias("page"), F.lit("").alias("label"), F.when(r % 2 != 0, box(o)).alias("box"))
    got = F.struct(sheet(r % 3).alias("sheet"), F.lit("").alias("tbl"), cells(r + 1, r + 1 + pg).alias("cells"), none.cast("bigint").alias("physical"), gpg.alias("page"), F.lit("").alias("label"), box(r).alias("box"))
    own = table(spark, sf, "lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("k"), want.alias("w"), got.alias("g"))
    return own.select("k", G.location_met(col("w"), col("g")).alias("met"))


@query("SELECT page_id, page_id % 3 <> 0 AND (contains(lower(html), 'footer') OR contains(lower(html), 'zz' || (page_id % 10)::VARCHAR)) AS leaks FROM pages")
def hidden_leaks(spark: SparkSession, sf: str) -> DataFrame:
    policy = F.when(F.col("page_id") % 3 == 1, "exclude_hidden").when(F.col("page_id") % 3 == 2, "negative").otherwise("allow")
    terms = F.concat(F.lit(" Footer ;| zz"), (F.col("page_id") % 10).cast("string"))
    return table(spark, sf, "pages").select("page_id", G.leaks(policy, terms, F.col("html")).alias("leaks"))


@query(f"""WITH {WANTED}, t AS (SELECT query_id, max(score) AS top, min(rank) FILTER (WHERE doc_id = wanted_chunk) AS gr, max(score) FILTER (WHERE doc_id = wanted_chunk) AS gs FROM g GROUP BY query_id)
SELECT query_id, CASE WHEN query_id % 5 = 0 AND query_id % 3 = 0 THEN CASE WHEN top < 0.35 THEN 'impossible' ELSE 'hard' END WHEN gr = 1 AND gs >= 0.4 THEN 'easy' WHEN gr <= 3 AND gs >= 0.3 THEN 'medium' WHEN gr IS NOT NULL THEN 'hard' END AS difficulty FROM t""")
def question_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    got = F.col("doc_id") == F.col("wanted_chunk")
    own = wanted(spark, sf).groupBy("query_id").agg(F.max("score").alias("top"), F.min(F.when(got, F.col("rank"))).alias("gr"), F.max(F.when(got, F.col("score"))).alias("gs"))
    kind = F.when((F.col("query_id") % 5 == 0) & (F.col("query_id") % 3 == 0), "unanswerable").otherwise("plain")
    return own.select("query_id", G.difficulty(kind, F.col("gr"), F.col("gs"), F.col("top"), 0.4, 0.3, 0.35).alias("difficulty"))
