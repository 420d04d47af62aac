"""Queries of sheets and pages: a customer's nation is a book, its segment a sheet, its orders rows; documents are pages of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import wiki
from corvane.operators import sheets as S
from corvane.plans.registry import query
from corvane.sources.tables import table

#: Rows of sheets: a row's third value is hidden for even customers and its second for every eleventh; what is empty at a row's end is not there.
CELLS = r"""v AS (SELECT c_nationkey AS book, c_mktsegment AS sheet, c_custkey AS row, c_name AS a, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 11 = 0 THEN '' ELSE round(c_acctbal)::INT::VARCHAR END AS b, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x|y' END AS c FROM customer),
r AS (SELECT book, sheet, row, CASE WHEN c <> '' THEN [a, b, c] WHEN b <> '' THEN [a, b] ELSE [a] END AS v, row_number() OVER (PARTITION BY book, sheet ORDER BY row) AS place FROM v QUALIFY place <= 10000),
f AS (SELECT book, sheet, count(*) AS total, max(len(v)) AS width, arg_min(v, place) FILTER (WHERE place <= 10 AND len(list_filter(v, lambda x: x <> '')) >= 2) AS first FROM r GROUP BY ALL),
n AS (SELECT *, list_transform(first, lambda x, i: CASE WHEN x = '' THEN chr((64 + i)::INT) ELSE x END) AS names FROM f),
s AS (SELECT r.*, names, total, width, names IS NOT NULL AND v = names[1:len(v)] AS same FROM r JOIN n USING (book, sheet)),
h AS (SELECT s.*, CASE WHEN names IS NOT NULL THEN coalesce(min(place) FILTER (WHERE same) OVER (PARTITION BY book, sheet), 1) ELSE 0 END AS head,
  array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN x <> '' THEN coalesce(names[i], chr((64 + i)::INT)) || ': ' || x END), lambda x: x IS NOT NULL), ' | ') AS line,
  '| ' || replace(array_to_string(list_transform(v[1:len(coalesce(names, v))], lambda x: replace(x, '|', '\|')), chr(1)), chr(1), ' | ') || repeat(' | ', greatest(len(coalesce(names, v)) - len(v), 0)::INT) || ' |' AS bar FROM s)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    col = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("col")
    own = table(spark, sf, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_mktsegment").alias("sheet"), k.alias("row"), "c_name", "c_acctbal", "c_custkey", col)
    value = F.when(F.col("col") == 1, F.col("c_name")).when(F.col("col") == 2, F.when(k % 5 == 0, "").otherwise(F.round("c_acctbal").cast("int").cast("string"))).otherwise("x|y")
    hidden = ((F.col("col") == 3) & (k % 2 == 0)) | ((F.col("col") == 2) & (k % 11 == 0))
    return own.select("book", "sheet", F.col("row").cast("int").alias("row"), "col", value.alias("value"), hidden.alias("hidden"))


@query(f"""WITH {CELLS}, g AS (SELECT book, sheet, (place - head - 1) // 50 AS part, min(row) AS a, max(row) AS b, max(len(v)) AS w, any_value(names) AS names, string_agg(line, chr(10) ORDER BY place) AS lines FROM h WHERE total > 51 AND place > head GROUP BY ALL),
t AS (SELECT book, sheet, len(v) AS w FROM h WHERE place = head),
c AS (SELECT g.*, 'A' || a || ':' || chr(64 + greatest(g.w, coalesce(t.w, 0))::INT) || b AS cells FROM g LEFT JOIN t USING (book, sheet))
SELECT book, sheet, part, cells, md5('[Sheet: ' || sheet || ']' || chr(10) || '[Range: ' || cells || ']' || chr(10) || lines) AS digest FROM c""")
def sheet_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.row_groups(S.rows_of(cells(spark, sf))).select("book", "sheet", "part", "cells", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {CELLS}, e AS (SELECT book, sheet, row, unnest(v) AS x, generate_subscripts(v, 1) AS col FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY book, sheet ORDER BY row, col) AS k FROM e WHERE x <> '')
SELECT book, sheet, least(count(*), 500) AS cells, max(row) FILTER (WHERE k <= 500)::INT AS last, count(*) > 500 AS cut FROM o GROUP BY ALL""")
def sheet_cells_exported(spark: SparkSession, sf: str) -> DataFrame:
    """Of each sheet the first 500 filled cells, which is what is exported, and whether there are more."""
    own = cells(spark, sf)
    return S.exported(own, S.rows_of(own)).groupBy("book", "sheet").agg(F.count("*").alias("cells"), F.max("row").alias("last"), F.any_value("cut").alias("cut"))


@query(rf"""WITH {CELLS}, b AS (SELECT book, sheet, any_value(names) AS names, string_agg(bar, chr(10) ORDER BY place) FILTER (WHERE place > head AND place <= head + 200) AS bars FROM h GROUP BY ALL)
SELECT book, sheet, md5(concat_ws(chr(10), '| ' || array_to_string(list_transform(names, lambda x: replace(x, '|', '\|')), ' | ') || ' |', '| ' || array_to_string(list_transform(names, lambda x: '---'), ' | ') || ' |', bars)) AS digest FROM b WHERE names IS NOT NULL""")
def sheet_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Of sheets with headers these and 200 rows at most, as is shown of a sheet."""
    own = S.headed(S.rows_of(cells(spark, sf))).where("headers is not null").select("book", "sheet").distinct()
    return S.markdown(S.rows_of(cells(spark, sf))).join(own, ["book", "sheet"]).select("book", "sheet", F.md5(F.col("table").cast("binary")).alias("digest"))


@query(f"""WITH {CELLS} SELECT unit_type, count(*) AS n FROM (SELECT DISTINCT 'DOCUMENT' AS unit_type, book::VARCHAR AS k FROM h UNION ALL SELECT DISTINCT 'SECTION', book::VARCHAR || sheet FROM h UNION ALL SELECT DISTINCT 'CHUNK', book::VARCHAR || sheet || ((place - head - 1) // 50)::VARCHAR FROM h WHERE total > 51 AND place > head) GROUP BY unit_type""")
def sheet_unit_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return S.sheet_units(S.rows_of(cells(spark, sf))).groupBy("unit_type").agg(F.count("*").alias("n"))


#: Ranges of rows and columns by nation: a table in one of its sheets, and two merged areas that meet in one row.
RANGES = """t AS (SELECT n_nationkey AS book, 'BUILDING' AS sheet, 0 AS at, n_name AS table_id, n_nationkey * 10 + 1 AS r0, n_nationkey * 10 + 400 AS r1, 1 AS c0, 2 AS c1 FROM nation WHERE n_regionkey < 3),
m AS (SELECT n_nationkey AS book, unnest(['BUILDING', 'FURNITURE']) AS sheet, i AS at, n_name || i AS name, n_nationkey * 10 + i * 60 AS r0, n_nationkey * 10 + i * 60 + 200 AS r1, 1 + i AS c0, 2 + i AS c1 FROM nation, (SELECT unnest([0, 1]) AS i))"""


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").where("n_regionkey < 3").select(n.alias("book"), F.lit("BUILDING").alias("sheet"), F.lit(0).alias("at"), F.col("n_name").alias("table_id"), (n * 10 + 1).alias("r0"), (n * 10 + 400).alias("r1"), F.lit(1).alias("c0"), F.lit(2).alias("c1"))


@query(f"""WITH {CELLS}, {RANGES}, i AS (SELECT t.*, v[c0:c1] AS v, row_number() OVER (PARTITION BY book, sheet ORDER BY row) AS place FROM t JOIN r USING (book, sheet) WHERE row BETWEEN r0 AND r1),
j AS (SELECT book, sheet, arg_min(v, place) FILTER (WHERE place <= 10 AND len(list_filter(v, lambda x: x <> '')) >= 2) AS names FROM i GROUP BY ALL),
k AS (SELECT t.book, t.sheet, t.table_id, 'named' AS kind, t.r0, t.r1, 2 AS c1, coalesce(j.names, n.names) AS names FROM t LEFT JOIN j USING (book, sheet) LEFT JOIN n USING (book, sheet)),
l AS (SELECT i.*, k.names, k.names IS NOT NULL AND v = k.names[1:len(v)] AS same FROM i JOIN k USING (book, sheet)),
p AS (SELECT *, coalesce(min(place) FILTER (WHERE same) OVER (PARTITION BY book, sheet), 1) AS head FROM l),
q AS (SELECT book, sheet, string_agg(array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN x <> '' THEN coalesce(names[i], chr((64 + i)::INT)) || ': ' || x END), lambda x: x IS NOT NULL), ' | '), chr(10) ORDER BY place) FILTER (WHERE names IS NULL OR place > head) AS lines FROM p GROUP BY ALL),
d AS (SELECT book, sheet, 'DetectedTable1' AS table_id, 'detected' AS kind, 1 AS r0, max(row) AS r1, any_value(width) AS c1, any_value(names) AS names, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE place > head) AS lines FROM h WHERE names IS NOT NULL AND total > 1 AND total * width <= 2000 AND NOT EXISTS (FROM t WHERE t.book = h.book AND t.sheet = h.sheet) GROUP BY book, sheet),
u AS (SELECT k.*, lines FROM k LEFT JOIN q USING (book, sheet) UNION ALL SELECT * FROM d),
w AS (SELECT *, 'A' || r0 || ':' || chr((64 + c1)::INT) || r1 AS cells FROM u)
SELECT book, sheet, table_id, kind, cells, 'A' || r0 || ':' || chr((64 + c1)::INT) || r0 AS header_cells, 'A' || least(r0 + 1, r1) || ':' || chr((64 + c1)::INT) || r1 AS data_cells, md5(left('[Sheet: ' || sheet || ']' || chr(10) || '[Range: ' || cells || ']' || coalesce(chr(10) || lines, ''), 29000)) AS digest FROM w""")
def sheet_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Named tables of nations' sheets, and those found in small sheets."""
    out = S.tables(S.rows_of(cells(spark, sf)), ranges(spark, sf))
    return out.select("book", "sheet", "table_id", "kind", "cells", "header_cells", "data_cells", F.md5(F.substring("text", 1, 29000).cast("binary")).alias("digest"))


@query(f"""WITH {CELLS}, {RANGES}, e AS (SELECT book, sheet, row, unnest(v) AS x, generate_subscripts(v, 1) AS col FROM r)
SELECT e.book, e.sheet, e.row::INT AS row, e.col::INT AS col, any_value(t.table_id) AS table_id, arg_max(m.name, m.at) AS merged FROM e LEFT JOIN t ON t.book = e.book AND t.sheet = e.sheet AND e.row BETWEEN t.r0 AND t.r1 AND e.col BETWEEN t.c0 AND t.c1
LEFT JOIN m ON m.book = e.book AND m.sheet = e.sheet AND e.row BETWEEN m.r0 AND m.r1 AND e.col BETWEEN m.c0 AND m.c1 WHERE x <> '' GROUP BY ALL""")
def placed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Filled cells with their table and the merged range that was named last."""
    rows = S.rows_of(cells(spark, sf))
    own = rows.select("book", "sheet", "row", F.posexplode("values").alias("at", "value")).where("value <> ''").select("book", "sheet", "row", (F.col("at") + 1).alias("col"))
    n = F.col("n_nationkey")
    each = table(spark, sf, "nation").select("*", F.explode(F.array(F.lit("BUILDING"), F.lit("FURNITURE"))).alias("sheet")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    i = F.col("at")
    merges = each.select(n.alias("book"), "sheet", "at", F.concat("n_name", i.cast("string")).alias("name"), (n * 10 + i * 60).alias("r0"), (n * 10 + i * 60 + 200).alias("r1"), (1 + i).alias("c0"), (2 + i).alias("c1"))
    return S.in_ranges(S.in_ranges(own, ranges(spark, sf), "table_id", "table_id"), merges, "name", "merged")


BLOCKS = "b AS (SELECT doc_id % 50 AS book, doc_id AS page, i AS block, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)), f AS (SELECT * FROM b WHERE trim(text) <> '')"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("book"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("block", "text"))


@query(f"""WITH {BLOCKS}, p AS (SELECT book, page, string_agg(text, chr(10) ORDER BY block) AS text FROM f GROUP BY ALL), u AS (SELECT book, 'DOCUMENT' AS unit_type, 'document' AS unit_key, substring(string_agg(text, chr(10) ORDER BY page), 1, 200000) AS text FROM p GROUP BY book UNION ALL SELECT book, 'PAGE', 'page:' || page::VARCHAR, text FROM p UNION ALL SELECT book, 'CHUNK', 'page:' || page::VARCHAR || ':block:' || block::VARCHAR, trim(text) FROM f)
SELECT book, unit_type, unit_key, md5(text) AS digest FROM u""")
def page_unit_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return S.page_units(blocks(spark, sf)).select("book", "unit_type", "unit_key", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {BLOCKS}, p AS (SELECT book, page, count(*) AS n, sum(length(text)) AS chars FROM b GROUP BY ALL), q AS (SELECT book, round(0.8::DOUBLE * avg(CASE WHEN chars > 0 THEN 1.0::DOUBLE ELSE 0 END) + 0.2::DOUBLE * least(sum(n) / count(*)::DOUBLE, 5.0::DOUBLE) / 5, 4) AS quality FROM p GROUP BY book)
SELECT book, quality, unread FROM q JOIN (SELECT book, count(*) FILTER (WHERE page % 7 = 0 OR chars < 20 OR chars / 1000000.0::DOUBLE < 0.0001) AS unread FROM p GROUP BY book) USING (book)""")
def page_reading(spark: SparkSession, sf: str) -> DataFrame:
    """The quality of a book's text layer, and how many pages have to be recognised."""
    pages = blocks(spark, sf).groupBy("book", "page").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))
    unread = pages.groupBy("book").agg(F.count_if(S.needs_reading(F.col("page") % 7 != 0, F.col("chars"), F.lit(1e6))).alias("unread"))
    return S.page_quality(pages).join(unread, "book")


@query("""SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_linenumber % 4 WHEN 0 THEN round(l_discount * 100)::INT::VARCHAR || '%' WHEN 1 THEN l_quantity::INT::VARCHAR ELSE regexp_replace(l_quantity::DECIMAL(28,10)::VARCHAR, '\\.?0+$', '') END AS shown FROM lineitem WHERE l_linenumber % 4 <> 3""")
def shown_values(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    value = F.when(n == 0, F.col("l_discount")).otherwise(F.col("l_quantity"))
    form = F.when(n == 0, "0%").when(n == 1, "0").otherwise("General")
    return table(spark, sf, "lineitem").where(n != 3).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), wiki.shown(value, form).alias("shown"))


@query()
def prepared_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the block of notes before a page's text and without edit markers; the block's pattern has no form in the other SQL."""
    own = table(spark, sf, "documents").select("doc_id", wiki.prepared(F.col("text")).alias("p"))
    return own.select("doc_id", F.md5(F.col("p.text").cast("binary")).alias("digest"), F.col("p.cut").alias("cut"), F.col("p.marks").alias("marks"), F.col("p.dropped").alias("dropped"))
