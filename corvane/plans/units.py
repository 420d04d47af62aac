"""Queries of texts built of units' fields, over lines of orders that stand for units of sheets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import units as U
from corvane.plans.registry import query
from corvane.plans.search import TOKENS
from corvane.sources.tables import table

ROLES, CANON = ("workbook", "sheet", "table", "chunk", "document", "page", "block", "other"), ("DOCUMENT", "PAGE", "SECTION", "TABLE", "IMAGE", "CHUNK")
UNITS = f"""u AS (SELECT l_orderkey * 10 + l_linenumber AS k, ['xlsx', 'pdf', 'ocr'][l_linenumber % 3 + 1] AS kind, 'f' || (l_partkey % 9)::VARCHAR || '.bin' AS file, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE 's' || (l_suppkey % 5)::VARCHAR END AS sheet, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'A1:B' || (l_suppkey % 7)::VARCHAR END AS cells, CASE WHEN l_partkey % 4 = 0 THEN 'workbook' ELSE 'x' END AS ukey,
CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 20)::VARCHAR END AS page, CASE WHEN l_partkey % 6 = 0 THEN 't' || (l_partkey % 3)::VARCHAR END AS tbl, l_partkey % 7 = 0 AS boxed, l_partkey % 2 = 0 AS ocr, l_partkey % 3 = 0 AS sure, ['{"','".join(ROLES)}'][l_suppkey % 8 + 1] AS role, ['{"','".join(CANON)}'][l_partkey % 6 + 1] AS canon, CASE WHEN l_suppkey % 2 = 0 THEN 'list' END AS block, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'title ' || (l_suppkey % 4)::VARCHAR END AS title, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE ' body ' || l_orderkey::VARCHAR || ' ' END AS body FROM lineitem),
c AS (SELECT *, CASE WHEN kind = 'xlsx' THEN concat_ws(' > ', file, nullif(trim(sheet), ''), coalesce(cells, CASE WHEN ukey = 'workbook' THEN 'workbook' END)) ELSE concat_ws(' > ', file, 'p.' || page, CASE WHEN boxed THEN 'bbox [1,2]' END) END AS cited,
CASE WHEN kind = 'xlsx' AND role = 'workbook' THEN 'workbook_summary' WHEN kind = 'xlsx' AND role = 'sheet' THEN 'sheet_summary' WHEN kind = 'xlsx' AND role = 'table' THEN 'table' WHEN kind = 'xlsx' AND role = 'chunk' THEN 'row_group' WHEN kind = 'pdf' AND role = 'document' THEN 'document_summary' WHEN kind = 'pdf' AND role = 'page' THEN 'page' WHEN kind = 'pdf' AND role = 'block' THEN coalesce(block, 'paragraph')
WHEN canon = 'DOCUMENT' THEN 'document_summary' WHEN canon = 'IMAGE' THEN 'figure_caption' WHEN canon = 'CHUNK' THEN 'ocr_block' ELSE lower(canon) END AS chunk FROM u)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    o, n, p, s = (F.col(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    text = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    headers = F.when(s % 2 == 0, F.array(F.array(F.lit("a"), F.lit(" b ")), F.array(F.lit("")), F.array(F.lit("c"))))
    place = F.struct(F.when(s % 3 == 0, " ").otherwise(text("s", s % 5)).alias("sheet"), F.when(s % 4 != 0, text("A1:B", s % 7)).alias("cells"), F.when(p % 4 == 0, "workbook").otherwise("x").alias("unit_key"), F.when(p % 5 != 0, (p % 20).cast("string")).alias("page"), F.when(p % 6 == 0, text("t", p % 3)).alias("tbl"), F.when(p % 7 == 0, F.array(F.lit(1), F.lit(2))).alias("box"), headers.alias("headers"), F.lit(None).cast("string").alias("page_label"), F.when(s % 2 == 0, "list").alias("block"), (p % 2 == 0).alias("ocr"), F.when(p % 3 == 0, "0.5").alias("sure"))
    own = table(spark, sf, "lineitem").select((o * 10 + n).alias("k"), pick(("xlsx", "pdf", "ocr"), n % 3).alias("kind"), F.concat(F.lit("f"), (p % 9).cast("string"), F.lit(".bin")).alias("file"), place.alias("place"), pick(ROLES, s % 8).alias("role"), pick(CANON, p % 6).alias("canon"), F.when(s % 5 != 0, text("title ", s % 4)).alias("title"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit(" body "), o.cast("string"), F.lit(" "))).alias("body"))
    own = own.withColumn("cited", U.citation(F.col("kind"), F.col("file"), F.col("place")))
    return own.withColumn("chunk", U.chunk_type(F.col("kind"), F.col("role"), F.col("place.block"), F.col("canon")))


@query(f"WITH {UNITS} SELECT k, cited, chunk FROM c")
def unit_citations(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("k", "cited", "chunk")


HEAD = "concat_ws(chr(10), 'Source: ' || file, 'Citation: ' || cited, 'Chunk: ' || chunk, "


@query(f"""WITH {UNITS}, e AS (SELECT k, concat_ws(chr(10), CASE WHEN kind = 'xlsx' THEN {HEAD}'Sheet: ' || nullif(trim(sheet), ''), 'Table: ' || tbl, 'Range: ' || cells, CASE WHEN block IS NOT NULL THEN 'Headers: a > b | c' END) ELSE {HEAD}'Page: ' || page, 'Block: ' || block, CASE WHEN ocr THEN 'OCR: used' END, CASE WHEN ocr AND sure THEN 'OCR confidence: 0.5' END) END, 'Content:' || chr(10) || coalesce(nullif(trim(body), ''), title)) AS t,
concat_ws(chr(10), file, cited, title, nullif(trim(body), '')) AS b FROM c) SELECT k, md5(t) AS embedded, md5(b) AS searched FROM e""")
def unit_texts(spark: SparkSession, sf: str) -> DataFrame:
    own = units(spark, sf)
    text = U.unit_text(*[F.col(c) for c in ("kind", "file", "cited", "chunk", "place", "title")], F.lit(None).cast("string"), F.col("body"))
    return own.select("k", F.md5(text.cast("binary")).alias("embedded"), F.md5(U.search_text(F.col("file"), F.col("cited"), F.col("title"), F.lit(" "), F.col("body")).cast("binary")).alias("searched"))


@query(f"""WITH {UNITS} SELECT k, CASE WHEN kind = 'xlsx' THEN '{{"type":"xlsx","document_version_id":"v1"' || coalesce(',"sheet_name":"' || nullif(trim(sheet), '') || '"', '') || coalesce(',"table_id":"' || tbl || '"', '') || coalesce(',"cell_range":"' || cells || '"', '') || ',"hidden_policy":"exclude_hidden"}}'
ELSE '{{"type":"' || kind || '","document_version_id":"v1","physical_page_index":' || CASE WHEN page IS NULL THEN '0' ELSE greatest(page::INT - 1, 0)::VARCHAR END || coalesce(',"page_no":' || page || ',"page_label":"' || page || '"', '') || CASE WHEN boxed THEN ',"bbox":[1,2]' ELSE '' END || ',"ocr_used":' || (ocr OR kind <> 'pdf')::VARCHAR || CASE WHEN sure THEN ',"ocr_confidence":"0.5"' ELSE '' END || '}}' END AS location FROM c""")
def unit_locations(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("k", U.location_json(F.col("kind"), F.lit("v1"), F.col("place")).alias("location"))


@query("""WITH f AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'T ' || (doc_id % 5)::VARCHAR END AS t, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'S' || (doc_id % 7)::VARCHAR END AS s, 'b' || doc_id::VARCHAR AS b FROM documents)
SELECT k, CASE WHEN t IS NULL THEN b ELSE '제목: ' || t || chr(10) || '본문: ' || b END AS titled, concat_ws(chr(10), '제목: ' || t, '섹션: ' || nullif(trim(s), ''), '본문: ' || b) AS sectioned, CASE WHEN t IS NULL AND trim(s) = '' THEN '' ELSE '[' || concat_ws(' / ', t, nullif(trim(s), '')) || ']' || chr(10) END || b AS compact,
concat_ws(chr(10), t, nullif(trim(s), ''), CASE WHEN k % 2 = 0 THEN 'Ab c' ELSE 'c' END, b) AS prefixed, coalesce(t, 'P') AS title FROM f""")
def passage_formats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    own = table(spark, sf, "documents").select(k.alias("k"), F.when(k % 3 != 0, F.concat(F.lit("T "), (k % 5).cast("string"))).alias("t"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("S"), (k % 7).cast("string"))).alias("s"), F.concat(F.lit("  b"), k.cast("string")).alias("b"), F.when(k % 2 == 0, F.array(F.lit(" Ab "), F.lit("c"), F.lit("ab"), F.lit(""))).otherwise(F.array(F.lit("c"), F.lit("C"))).alias("w"))
    t, s, b = F.col("t"), F.col("s"), F.col("b")
    return own.select("k", U.passage("title_plus_chunk", b, t, s).alias("titled"), U.passage("title_section_plus_chunk", b, t, s).alias("sectioned"), U.passage("compact_metadata_plus_chunk", b, t, s).alias("compact"), U.prefix_text("all", t, s, F.col("w"), b).alias("prefixed"), U.resolved_title("retrieval_title_section", F.lit("P"), t).alias("title"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || (o_orderkey % 50)::VARCHAR END AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || (o_orderkey % 9)::VARCHAR END AS s, CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || (o_orderkey % 70)::VARCHAR END AS c FROM orders),
g AS (SELECT k, CASE WHEN u IS NOT NULL THEN 'search_unit:' || u WHEN s IS NOT NULL THEN 'source_file:' || s || ':unit:PAGE:p' WHEN c IS NOT NULL THEN 'chunk:' || c ELSE 'doc:d:section:' END AS key FROM f) SELECT key, count(*) AS n, min(k) AS first FROM g GROUP BY key""")
def same_units(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    key = U.same_unit_key(F.when(k % 3 == 0, text("u", k % 50)), F.when(k % 2 == 0, text("f", k % 9)), F.lit("PAGE"), F.lit("p"), F.when(k % 5 != 0, text("c", k % 70)), F.lit("d"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(k).alias("first"))


@query("""WITH f AS (SELECT doc_id, text, (doc_id % 100) / 7.0::DOUBLE AS s, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE WHEN doc_id % 3 = 1 THEN 0.5::DOUBLE END AS d FROM documents)
SELECT doc_id, round(s, 6) AS score, round(coalesce(nullif(d, 0), s), 6) AS dense, md5(CASE WHEN length(text) > 240 THEN rtrim(substring(text, 1, 240), ' ') || '...' ELSE text END) AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'f' ELSE doc_id::VARCHAR END AS source, 'CHUNK' AS kind FROM f""")
def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    none = F.lit(None)
    r = F.struct(F.lit(1).alias("rank"), k.cast("string").alias("chunk_id"), k.cast("string").alias("doc_id"), F.lit("s").alias("section"), ((k % 100) / 7.0).alias("score"), F.col("text").alias("text"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.5).alias("dense"), none.cast("double").alias("sparse"), none.cast("double").alias("rerank"), none.cast("string").alias("unit"), F.when(k % 2 == 0, "f").alias("source"), F.lit(" ").alias("kind"), none.cast("string").alias("path"))
    own = table(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", U.result_row(F.col("r")).alias("o"))
    return own.select("doc_id", F.col("o.score").alias("score"), F.col("o.denseScore").alias("dense"), F.md5(F.col("o.snippet").cast("binary")).alias("snippet"), F.col("o.citation.sourceFileId").alias("source"), F.col("o.citation.unitType").alias("kind"))


@query("""WITH f AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'why' WHEN 1 THEN 'what does it say here' ELSE ' ' END AS q, CASE WHEN turn % 3 <> 0 THEN trim(text) END AS o, CASE WHEN turn % 2 = 0 THEN 'a cat' END AS c FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN trim(q) = 'why' AND o IS NOT NULL THEN 'why ' || substring(o, 1, 200) ELSE coalesce(nullif(trim(q), ''), substring(o, 1, 200), c, 'document') END) AS query, md5('[question]' || chr(10) || coalesce(nullif(trim(q), ''), '(empty)') || chr(10) || chr(10) || '[ocr]' || chr(10) || coalesce(nullif(o, ''), '(empty)') || chr(10) || chr(10) || '[vision]' || chr(10) || coalesce('- ' || c, '(empty)')) AS context FROM f""")
def multimodal_fusion(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    q = F.when(c % 4 == 0, "why").when(c % 4 == 1, "what does it say here").otherwise(" ")
    o, seen = F.when(F.col("turn") % 3 != 0, F.col("text")), F.when(F.col("turn") % 2 == 0, "a cat")
    fused = U.fused_context(q, o, F.array(F.coalesce(seen, F.lit(""))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(U.retrieval_query(q, o, seen).cast("binary")).alias("query"), F.md5(fused.cast("binary")).alias("context"))


VARIANTS = ("raw", "title", "section", "title_section", "keyword", "all")


@query(rf"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS body, lang, source, list_slice({TOKENS.format("text")}, 1, 3) AS w FROM documents),
k AS (SELECT *, array_to_string(w, ' ') AS title, CASE WHEN lang = 'en' THEN source || ' / ' || array_to_string(w, ' ') ELSE '' END AS other FROM t),
d AS (SELECT doc_id, body, title, other, lang, source, CASE WHEN len(w) = 0 THEN NULL ELSE array_to_string(list_transform(list_filter(w, lambda x, i: NOT list_contains(list_transform(w[1:i - 1], lambda y: lower(y)), lower(x))), lambda x: x), ' ') END AS words FROM k),
p AS (SELECT doc_id, 'production:title_section' AS variant, concat_ws(chr(10) || chr(10), concat_ws(chr(10), '제목: ' || nullif(title, ''), '섹션: ' || concat_ws(' > ', nullif(lang, ''), nullif(source, ''))), '본문:' || chr(10) || nullif(body, '')) AS x FROM d
UNION ALL SELECT doc_id, 'production:retrieval_title_section', concat_ws(chr(10) || chr(10), concat_ws(chr(10), '제목: ' || nullif(coalesce(nullif(other, ''), title), ''), '섹션: ' || concat_ws(' > ', nullif(lang, ''), nullif(source, ''))), '본문:' || chr(10) || nullif(body, '')) FROM d
UNION ALL SELECT doc_id, v, concat_ws(chr(10), CASE WHEN v IN ('title', 'title_section', 'all') THEN nullif(title, '') END, CASE WHEN v IN ('section', 'title_section', 'all') THEN nullif(source, '') END, CASE WHEN v IN ('keyword', 'all') THEN nullif(words, '') END, nullif(body, '')) FROM d, (SELECT unnest(['{"','".join(VARIANTS)}']) AS v))
SELECT doc_id, variant, md5(x) AS digest FROM p""")
def embedding_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A document's text as each variant embeds it, by digest: its first words are title and keywords, its language and source the section."""
    words = F.slice(T.tokens(F.col("text")), 1, 3)
    own = table(spark, sf, "documents").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("body"), "lang", "source", words.alias("words")).withColumn("title", F.array_join("words", " "))
    other = F.when(F.col("lang") == "en", F.concat("source", F.lit(" / "), "title")).otherwise("")
    path = F.array_compact(F.array("lang", "source"))
    texts = {f"production:{v}": U.production_text(v, F.col("title"), other, path, F.lit(""), F.col("body")) for v in ("title_section", "retrieval_title_section")}
    texts |= {v: U.prefix_text(v, F.col("title"), F.col("source"), F.col("words"), F.col("body")) for v in VARIANTS}
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.md5(x.cast("binary")).alias("digest")) for v, x in texts.items()])).alias("x")
    return own.select("doc_id", each).select("doc_id", "x.*")
