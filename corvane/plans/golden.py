"""Queries of the evaluation of gold rows: orders want places that their lines, as ranked hits, meet or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gate, golden
from corvane.operators.retrieval import ranked
from corvane.plans.registry import query
from corvane.sources import scratch
from corvane.sources.tables import table

ROWS = """WITH l AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_returnflag AS f, l_linestatus AS s, year(l_shipdate) AS t,
  month(l_shipdate) AS m, day(l_shipdate) AS d, round(l_tax * 100)::INT AS x, l_extendedprice AS price FROM lineitem),
b AS (SELECT q, arg_max(f, price) AS f, arg_min(s, price) AS s FROM l GROUP BY q),
g AS (SELECT o_orderkey AS q, o_orderpriority AS bucket, left(o_orderpriority, 1)::INT AS p, CASE o_orderstatus WHEN 'F' THEN 'xlsx' WHEN 'O' THEN 'pdf' ELSE '' END AS kind, o_custkey % 97 = 0 AS bad,
  CASE WHEN o_totalprice < 250000 THEN b.f END AS f, CASE WHEN o_totalprice < 200000 THEN b.s END AS s, CASE WHEN o_totalprice < 90000 THEN year(o_orderdate) END AS t, month(o_orderdate) AS m, day(o_orderdate) AS d, o_totalprice > 150000 AS box FROM orders LEFT JOIN b ON b.q = o_orderkey),
h AS (SELECT g.q, rank, coalesce(g.f = l.f, true) AS file, l.f <> 'R' AS ok, g.kind = '' OR g.kind = CASE WHEN l.s = 'O' THEN 'xlsx' ELSE 'pdf' END AS typed, coalesce(g.s = l.s, true) AS sheet, coalesce(g.t = l.t, true) AS tbl, l.s = 'O' AS candidate,
  l.m = g.m AND l.x = 3 AS exact, l.m <= g.m AND l.m + l.x >= g.m + 3 AS covers, l.m <= g.m + 3 AND g.m <= l.m + l.x AS meets, l.m = g.m AS page, l.d <= g.d + 5 AND g.d <= l.d + 5 AS near, abs(l.d - g.d) = 0 AS same,
  g.p = 1 OR g.p = 2 AS guarded, l.f = 'R' AND l.s = 'F' AS blocked, g.* EXCLUDE (q, f, s, t, m, d) FROM g JOIN l USING (q) WHERE rank <= 10),
i AS (SELECT *, CASE p WHEN 5 THEN true WHEN 1 THEN exact WHEN 2 THEN covers ELSE meets END AS policy FROM h),
a AS (SELECT q, count(*) AS hits, count(*) FILTER (WHERE NOT ok) AS filtered, min(rank) FILTER (WHERE file AND typed AND ok) AS hit_rank,
  min(rank) FILTER (WHERE file AND typed AND ok AND CASE kind WHEN 'xlsx' THEN sheet AND tbl AND policy WHEN 'pdf' THEN page AND (NOT box OR near) ELSE true END) AS location_rank,
  bool_or(candidate) AS cand, bool_or(ok) AS ok, bool_or(file) AS file, bool_or(file AND sheet) AS sheet, bool_or(file AND sheet AND tbl) AS tbl, bool_or(file AND sheet AND tbl AND policy) AS cells,
  bool_or(file AND sheet AND tbl AND meets) AS overlap, bool_or(file AND sheet AND tbl AND covers) AS contains, bool_or(file AND sheet AND tbl AND exact) AS exact, bool_or(file AND page) AS page, bool_or(file AND page AND near) AS near, bool_or(file AND page AND same) AS same,
  bool_or(guarded AND blocked) AS leak FROM i GROUP BY q),
r AS (SELECT g.q, bucket, p, kind, bad, g.f IS NOT NULL AS wf, g.s IS NOT NULL AS ws, g.t IS NOT NULL AS wt, box, coalesce(hits, 0) AS hits, coalesce(filtered, 0) AS filtered, hit_rank, location_rank, coalesce(leak, false) AS leak, cand, ok, file, sheet, tbl, cells, overlap, contains, exact, page, near, same, NOT bad AND p <> 1 AS live FROM g LEFT JOIN a USING (q)),
e AS (SELECT *, CASE WHEN bad THEN 'match_policy_error' WHEN p = 1 THEN CASE WHEN leak THEN 'hidden_content_returned' END WHEN leak THEN 'hidden_content_returned' WHEN location_rank IS NOT NULL THEN NULL WHEN hits = 0 THEN 'search_result_empty'
  WHEN NOT cand THEN 'candidate_index_mismatch' WHEN NOT ok THEN 'embedding_status_mismatch' WHEN NOT file THEN 'expected_file_not_found' WHEN kind = 'xlsx' AND ws AND NOT sheet THEN 'expected_sheet_not_found'
  WHEN kind = 'xlsx' AND wt AND NOT tbl THEN 'expected_table_not_found' WHEN kind = 'xlsx' AND NOT cells THEN 'expected_range_not_found' WHEN kind = 'pdf' AND NOT page THEN 'expected_page_not_found' WHEN kind = 'pdf' AND box AND NOT near THEN 'bbox_mismatch' ELSE 'unknown' END AS reason FROM r),
x AS (SELECT *, CASE WHEN bad THEN 'invalid_gold' WHEN p = 1 THEN CASE WHEN leak THEN 'hidden_negative_failed' ELSE 'hidden_negative_pass' END WHEN leak THEN 'hidden_content_returned' WHEN reason IS NULL THEN 'matched' WHEN reason = 'search_result_empty' THEN 'search_result_empty' ELSE 'not_matched' END AS outcome FROM e)"""


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    text = lambda x: x.cast("string")
    cells = lambda m, n: F.concat(F.lit("A"), text(m), F.lit(":C"), text(m + n))
    box = lambda d: F.array(d.cast("double"), F.lit(0.0), (d + 5).cast("double"), F.lit(1.0))
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "query_id")
    lines = ranked(lines, "query_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    m, d, none = F.month("l_shipdate"), F.dayofmonth("l_shipdate"), F.lit(None)
    got = F.struct(
        c("l_returnflag").alias("file"), none.cast("string").alias("docv"), F.lit("c").alias("chunk"), F.when(c("l_linestatus") == "O", "xlsx").otherwise("pdf").alias("kind"), c("l_linestatus").alias("sheet"), text(F.year("l_shipdate")).alias("tbl"),
        cells(m, F.round(c("l_tax") * 100).cast("int")).alias("cells"), none.cast("int").alias("physical"), m.alias("page"), F.lit("").alias("label"), box(d).alias("box"),
        F.when(c("l_linestatus") == "O", "v2").otherwise("v1").alias("index"), F.when(c("l_returnflag") == "R", "failed").otherwise("Embedded").alias("status"),
    )
    hits = lines.select("query_id", "rank", F.concat_ws("/", "l_returnflag", "l_linestatus").alias("body"), got.alias("got"))
    # Of equal prices the first line by rank counts, and lines without a price or the value don't.
    at = lambda c, place: F.when(F.col(c).isNotNull() & F.col("l_extendedprice").isNotNull(), F.struct("l_extendedprice", place))
    best = lines.groupBy("query_id").agg(F.max_by("l_returnflag", at("l_returnflag", -F.col("rank"))).alias("f"), F.min_by("l_linestatus", at("l_linestatus", F.col("rank"))).alias("s"))
    own = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "query_id").join(best, "query_id", "left")
    p, price, om, od = F.substring("o_orderpriority", 1, 1).cast("int"), c("o_totalprice"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    kind = F.when(c("o_orderstatus") == "F", "xlsx").when(c("o_orderstatus") == "O", "pdf").otherwise("")
    policy = F.when(p == 5, "none").when(p == 1, "exact_match").when(p == 2, "contains_expected").otherwise("overlaps_expected")
    want = F.struct(
        F.when(price < 250000, c("f")).alias("file"), F.lit("").alias("docv"), F.lit("c").alias("chunk"), kind.alias("kind"), F.when(price < 200000, c("s")).alias("sheet"), F.when(price < 90000, text(F.year("o_orderdate"))).alias("tbl"),
        cells(om, F.lit(3)).alias("cells"), policy.alias("policy"), none.cast("int").alias("physical"), om.alias("page"), F.lit("").alias("label"), F.when(price > 150000, box(od)).alias("box"),
    )
    errors = F.when(c("o_custkey") % 97 == 0, F.array(F.lit("range_match_policy is not known")))
    hidden = F.when(p == 1, "negative").when(p == 2, "exclude_hidden").otherwise("")
    gold = own.select("query_id", c("o_orderpriority").alias("bucket"), hidden.alias("hidden_policy"), F.lit("zz; R/f").alias("terms"), errors.alias("errors"), F.lit(False).alias("failed"), want.alias("want"))
    return golden.evaluated(gold, hits, candidate="v2")


@query(f"{ROWS} SELECT q AS query_id, CASE WHEN live THEN hit_rank END AS hit_rank, CASE WHEN live THEN location_rank END AS location_rank, outcome, reason FROM x")
def gold_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("query_id", "hit_rank", "location_rank", "outcome", "reason")


def _share(flag: str, when: str = "true") -> str:
    return f"round(coalesce(avg(coalesce({flag}, false)::INT) FILTER (WHERE live AND {when}), 0), 4)"


@query(f"""{ROWS} SELECT bucket, count(*) FILTER (WHERE live) AS count, {", ".join(f"{_share(f'hit_rank <= {k}')} AS hit_at_{k}" for k in (1, 3, 5, 10))},
  round(coalesce(avg(coalesce(1.0::DOUBLE / hit_rank, 0)) FILTER (WHERE live), 0), 4) AS mrr_at_10, {_share("location_rank IS NOT NULL")} AS citation_location_accuracy,
  {_share("location_rank IS NOT NULL", "kind = 'xlsx'")} AS xlsx_citation_location_accuracy, {_share("location_rank IS NOT NULL", "kind = 'pdf'")} AS pdf_citation_location_accuracy,
  {_share("file", "kind = 'xlsx'")} AS xlsx_file_hit, {_share("sheet", "kind = 'xlsx'")} AS xlsx_sheet_hit, {_share("tbl", "kind = 'xlsx' AND wt")} AS xlsx_table_hit,
  {_share("overlap", "kind = 'xlsx'")} AS xlsx_range_overlap, {_share("contains", "kind = 'xlsx'")} AS xlsx_range_contains, {_share("exact", "kind = 'xlsx'")} AS xlsx_exact_range,
  {_share("file", "kind = 'pdf'")} AS pdf_file_hit, {_share("page", "kind = 'pdf'")} AS pdf_page_hit, {_share("near", "kind = 'pdf' AND box")} AS pdf_bbox_overlap, {_share("same", "kind = 'pdf' AND box")} AS pdf_exact_bbox,
  count(*) FILTER (WHERE hits = 0 AND NOT bad) AS result_empty, count(*) FILTER (WHERE bad) AS invalid, count(*) FILTER (WHERE leak AND NOT bad) AS leaks, count(*) FILTER (WHERE outcome = 'hidden_negative_pass') AS negative_pass,
  coalesce(sum(filtered) FILTER (WHERE NOT bad), 0)::BIGINT AS filtered FROM x GROUP BY ROLLUP (bucket)""")
def gold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by bucket and for all rows (a null bucket)."""
    return golden.metrics(evaluated(spark, sf))


@query(f"{ROWS} SELECT bucket, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((bucket, reason), (reason))")
def location_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Why rows failed, by bucket and for all rows (a null bucket)."""
    return golden.reasons(evaluated(spark, sf))


#: The gold rows' metrics under the gate's names, by bucket as an index version, all rows' as the baseline; some are missing.
GATED = f"""{ROWS}, t AS (SELECT coalesce(bucket, 'all') AS v, {_share("hit_rank <= 10")} AS hit, round(coalesce(avg(coalesce(1.0::DOUBLE / hit_rank, 0)) FILTER (WHERE live), 0), 4) AS mrr, {_share("location_rank IS NOT NULL")} AS cited,
  {_share("location_rank IS NOT NULL", "kind = 'xlsx'")} AS sheets, {_share("location_rank IS NOT NULL", "kind = 'pdf'")} AS pages, count(*) FILTER (WHERE leak AND NOT bad) AS leaks, coalesce(sum(filtered) FILTER (WHERE NOT bad), 0) AS filtered, count(*) FILTER (WHERE reason = 'candidate_index_mismatch') AS other FROM x GROUP BY ROLLUP (bucket)),
m AS (SELECT v, unnest(['Hit@10', 'mrr_at_10', 'citation_location_accuracy', 'xlsx_citation_location_accuracy', 'pdf_citation_location_accuracy', 'hidden_content_leakage_count', 'indexing_filtered_hit_count', 'candidate_index_mismatch_count', 'fatal_warning_count']) AS name, unnest([hit, mrr, cited, sheets, pages, leaks, filtered, other, 0]::DOUBLE[]) AS value FROM t)"""


@query(f"""WITH {GATED.removeprefix('WITH ')}, mb AS (SELECT name, value FROM m WHERE v = 'all'), ch AS (FROM (VALUES {", ".join(f"({i}, '{n}', '{o}', '{k}', {x}::DOUBLE)" for i, (n, o, k, x) in enumerate(gate.CHECKS, 1))}) r(place, name, other, kind, least)),
ev AS (SELECT k.v, place, ch.name, kind, least, coalesce(p.value, q.value) AS value, coalesce(pb.value, qb.value) AS base FROM (SELECT DISTINCT v FROM m WHERE v <> 'all') k CROSS JOIN ch LEFT JOIN m p ON p.v = k.v AND p.name = ch.name LEFT JOIN m q ON q.v = k.v AND q.name = ch.other LEFT JOIN mb pb ON pb.name = ch.name LEFT JOIN mb qb ON qb.name = ch.other),
w AS (SELECT v, place, CASE kind WHEN 'ocr' THEN NULL WHEN 'version' THEN CASE WHEN v <> '1-URGENT' THEN 'required_index_version must match promoted index_version' END WHEN 'filtered' THEN NULL WHEN 'status' THEN 'required_embedding_status must be EMBEDDED'
  ELSE CASE WHEN value IS NULL THEN name || ' is required' WHEN kind = 'delta' AND value < base + least THEN name || ' must be >= baseline - ' || printf('%.2f', abs(least)) || ' (' || printf('%.3f', base + least) || ')' WHEN kind = 'min' AND value < least THEN name || ' must be >= ' || printf('%.2f', least)
    WHEN kind = 'max' AND value > least THEN name || ' must be <= ' || printf('%.2f', least) WHEN kind = 'exact' AND value::BIGINT <> least::BIGINT THEN name || ' must be ' || least::BIGINT END END AS reason FROM ev)
SELECT v AS index_version, 'BLOCKED' AS decision, string_agg(reason, '; ' ORDER BY place) AS reasons FROM w GROUP BY v""")
def gate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of gold rows as index versions before the gate, beside all rows as their baseline."""
    rows = scratch.written(evaluated(spark, sf))
    sums = golden.metrics(rows).join(golden.reasons(rows).where("reason = 'candidate_index_mismatch'").select(F.col("bucket").alias("b"), F.col("n").alias("other")), F.col("bucket").eqNullSafe(F.col("b")), "left")
    names = {"Hit@10": "hit_at_10", "mrr_at_10": "mrr_at_10", "citation_location_accuracy": "citation_location_accuracy", "xlsx_citation_location_accuracy": "xlsx_citation_location_accuracy", "pdf_citation_location_accuracy": "pdf_citation_location_accuracy", "hidden_content_leakage_count": "leaks", "indexing_filtered_hit_count": "filtered", "candidate_index_mismatch_count": "other"}
    pairs = [F.struct(F.lit(k).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for k, c in names.items()]
    fixed = [("fatal_warning_count", 0.0, None), ("embedding_filtered_eval", None, "true"), ("required_embedding_status", None, "pending"), ("required_index_version", None, "1-URGENT")]
    pairs += [F.struct(F.lit(k).alias("name"), F.lit(v).cast("double").alias("value"), F.lit(t).cast("string").alias("text")) for k, v, t in fixed]
    own = sums.select(F.col("bucket").alias("index_version"), F.explode(F.array(*pairs)).alias("x")).select("index_version", "x.*")
    out = gate.decided(own.where("index_version is not null"), own.where("index_version is null").select("name", "value"))
    return out.select("index_version", "decision", F.array_join("reasons", "; ").alias("reasons"))
