"""Queries of verdict trees over facts of orders: an order stands for an experiment, a run or a gold row, and its key's remainders for the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import quantiles
from corvane.operators import verdicts as V
from corvane.plans.registry import query
from corvane.sources.tables import table

#: A figure is (a * key % m - shift) / 1000, null where key % gap = 0.
FIGURES = {"h5": (7, 31, 15, 17), "mrr": (11, 29, 14, 19), "c50": (13, 27, 13, 23), "c100": (5, 25, 12, 29)}


def figure(key: Column, name: str, plus: int = 0) -> Column:
    a, m, shift, gap = FIGURES[name]
    key = key + plus
    return F.when(key % gap != 0, ((key * a) % m - shift) / 1000.0)


def deltas(key: Column, plus: int = 0) -> Column:
    return F.struct(*[figure(key, x, plus).alias(x) for x in FIGURES], (((key + plus) % 9) / 5.0).alias("ratio"))


def figure_sql(name: str, plus: int = 0) -> str:
    a, m, shift, gap = FIGURES[name]
    return f"CASE WHEN (k + {plus}) % {gap} <> 0 THEN (((k + {plus}) * {a}) % {m} - {shift}) / 1000.0::DOUBLE END"


def deltas_sql(tag: str, plus: int = 0) -> str:
    return ", ".join(f"{figure_sql(x, plus)} AS {tag}{x}" for x in FIGURES) + f", ((k + {plus}) % 9) / 5.0::DOUBLE AS {tag}ratio"


def lift_sql(t: str) -> str:
    return f"(coalesce({t}h5 >= 0.005, false) OR coalesce({t}mrr >= 0.005, false)) AND coalesce({t}h5 >= -0.005, true)"


def loss_sql(t: str) -> str:
    return f"(coalesce({t}h5 <= -0.005, false) OR coalesce({t}mrr <= -0.005, false) OR coalesce({t}c50 <= -0.005, false))"


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))


FACTS = f"f AS (SELECT k, {deltas_sql('')} FROM (SELECT o_orderkey AS k FROM orders))"


@query(f"""WITH {FACTS} SELECT k, CASE WHEN k % 97 = 0 THEN 'baseline' WHEN {loss_sql('')} THEN 'regression' WHEN (coalesce(h5 >= 0.005, false) OR coalesce(mrr >= 0.005, false)) THEN CASE WHEN ratio > 1.5 THEN 'diagnostic_only' ELSE 'promising_quality' END
WHEN coalesce(abs(h5) < 0.005, true) AND coalesce(abs(mrr) < 0.005, true) THEN CASE WHEN c50 >= 0.005 THEN 'diagnostic_only' ELSE 'inconclusive' END ELSE 'diagnostic_only' END AS grade FROM f""")
def delta_grades(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return keys(spark, sf).select("k", V.grade(deltas(k), k % 97 == 0).alias("grade"))


@query(f"""WITH f AS (SELECT k, {deltas_sql('t')}, {deltas_sql('s', 3)} FROM (SELECT o_orderkey AS k FROM orders))
SELECT k, CASE WHEN {lift_sql('s')} AND NOT {loss_sql('s')} AND sratio <= 1.5 THEN 'ADOPT_TITLE_SECTION_INDEX' WHEN {lift_sql('t')} AND NOT {loss_sql('t')} AND tratio <= 1.5 AND (NOT ({lift_sql('s')}) OR {loss_sql('s')}) THEN 'ADOPT_TITLE_INDEX'
WHEN ((coalesce(sc50 >= 0.005, false) OR coalesce(sc100 >= 0.005, false)) AND coalesce(sh5 < 0.005, true) AND coalesce(smrr < 0.005, true)) OR ((coalesce(tc50 >= 0.005, false) OR coalesce(tc100 >= 0.005, false)) AND coalesce(th5 < 0.005, true) AND coalesce(tmrr < 0.005, true)) THEN 'NEED_RERANKER_INPUT_AUDIT_FIRST' ELSE 'KEEP_RAW_INDEX' END AS verdict FROM f""")
def index_text_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    own = keys(spark, sf).select("k", deltas(k).alias("t"), deltas(k, 3).alias("s"))
    return own.select("k", V.index_verdict(F.col("t"), F.col("s")).alias("verdict"))


POLICIES = ("title_cap_1", "title_cap_2", "title_cap_3", "doc_id_cap", "no_cap", "section_path_cap")


@query(f"""WITH p AS (SELECT k // 6 AS run, ['{"','".join(POLICIES)}'][k % 6 + 1] AS policy, {deltas_sql('')}, (k * 3 % 7 - 3) / 100.0::DOUBLE AS dup, (k % 5) / 10.0::DOUBLE AS rel, k % 4 AS capped FROM (SELECT o_orderkey AS k FROM orders)),
e AS (SELECT *, policy <> 'title_cap_1' AND {lift_sql('')} AND NOT {loss_sql('')} AND ratio <= 1.5 AS ok, round(coalesce(h5, 0) + coalesce(mrr, 0), 9) AS s FROM p),
l AS (SELECT run, policy, s FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC, dup, policy DESC) AS n FROM e WHERE ok) WHERE n = 1),
g AS (SELECT run, max(s) FILTER (WHERE ok AND policy = 'doc_id_cap') AS doc, max(s) FILTER (WHERE ok AND policy = 'no_cap') AS none, bool_and(rel < 0.45) AS low, greatest(coalesce(max(capped) FILTER (WHERE policy = 'title_cap_1') - min(capped), 0), 0) AS dropped FROM e GROUP BY run)
SELECT g.run, CASE WHEN l.run IS NULL THEN CASE WHEN low AND dropped < 5 THEN 'NEED_SCHEMA_ENRICHMENT' ELSE 'KEEP_TITLE_CAP_RERANK_INPUT_1' END ELSE CASE CASE WHEN policy <> 'doc_id_cap' AND round(s - doc, 9) <= 0.005 THEN 'doc_id_cap' WHEN policy <> 'no_cap' AND round(s - none, 9) <= 0.005 THEN 'no_cap' ELSE policy END
WHEN 'title_cap_2' THEN 'ADOPT_TITLE_CAP_RERANK_INPUT_2' WHEN 'title_cap_3' THEN 'ADOPT_TITLE_CAP_RERANK_INPUT_3' WHEN 'no_cap' THEN 'ADOPT_NO_CAP_RERANK_INPUT' ELSE 'ADOPT_DOC_ID_LEVEL_CAP' END END AS verdict FROM g LEFT JOIN l USING (run)""")
def cap_policy_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    policy = F.element_at(F.array(*map(F.lit, POLICIES)), (k % 6 + 1).cast("int"))
    rows = keys(spark, sf).select(F.floor(k / 6).alias("run"), policy.alias("policy"), deltas(k).alias("d"), ((k * 3 % 7 - 3) / 100.0).alias("dup"), ((k % 5) / 10.0).alias("relation_h5"), (k % 4).alias("capped_out"))
    return V.cap_verdicts(rows)


FORMS = ("chunk_only", "title_plus_chunk", "title_section_plus_chunk", "compact_metadata_plus_chunk")


@query(f"""WITH p AS (SELECT k // 8 AS run, CASE WHEN k // 4 % 2 = 0 THEN 'raw' ELSE 'title_section' END AS variant, ['{"','".join(FORMS)}'][k % 4 + 1] AS format, {deltas_sql('')}, (k * 3 % 7 - 3) / 100.0::DOUBLE AS dup FROM (SELECT o_orderkey AS k FROM orders)),
e AS (SELECT *, NOT {loss_sql('')} AND ratio <= 1.5 AS passing, {lift_sql('')} AS lift, round(coalesce(h5, 0) + coalesce(mrr, 0), 9) AS s FROM p),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, format ORDER BY passing DESC, s DESC, (lift AND passing) DESC) AS n FROM e WHERE format <> 'chunk_only') WHERE n = 1 AND lift AND passing),
l AS (SELECT run, format FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC, CASE format WHEN 'title_section_plus_chunk' THEN 0 WHEN 'title_plus_chunk' THEN 1 ELSE 2 END) AS m FROM b) WHERE m = 1),
g AS (SELECT run, coalesce(bool_or(format = 'chunk_only' AND variant <> 'raw' AND (coalesce(c50 >= 0.005, false) OR coalesce(c100 >= 0.005, false))), false) AND coalesce(bool_or(format <> 'chunk_only' AND dup >= 0.01), false) AS crowd FROM e GROUP BY run)
SELECT g.run, CASE format WHEN 'title_section_plus_chunk' THEN 'ADOPT_RERANKER_TITLE_SECTION_PREFIX' WHEN 'title_plus_chunk' THEN 'ADOPT_RERANKER_TITLE_PREFIX' WHEN 'compact_metadata_plus_chunk' THEN 'ADOPT_COMPACT_METADATA_PREFIX' ELSE CASE WHEN crowd THEN 'NEED_CHUNKING_DIVERSITY_EXPERIMENT' ELSE 'KEEP_CHUNK_ONLY_RERANKER_INPUT' END END AS verdict FROM g LEFT JOIN l USING (run)""")
def reranker_format_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % 4 + 1).cast("int"))
    variant = F.when(F.floor(k / 4) % 2 == 0, "raw").otherwise("title_section")
    rows = keys(spark, sf).select(F.floor(k / 8).alias("run"), variant.alias("variant"), form.alias("format"), deltas(k).alias("d"), ((k * 3 % 7 - 3) / 100.0).alias("dup"))
    return V.format_verdicts(rows)


@query("""WITH f AS (SELECT o_orderkey AS k, (o_orderkey * 7 % 31) / 1000.0::DOUBLE AS bh, (o_orderkey * 11 % 29) / 1000.0::DOUBLE AS bm, (o_orderkey * 5 % 31) / 1000.0::DOUBLE AS ph, (o_orderkey * 13 % 29) / 1000.0::DOUBLE AS pm, (o_orderkey * 3 % 31) / 1000.0::DOUBLE AS oh, (o_orderkey * 17 % 29) / 1000.0::DOUBLE AS om, (o_orderkey % 9) / 5.0::DOUBLE AS ratio FROM orders)
SELECT k, CASE WHEN round(ph - bh, 9) <= -0.005 AND round(pm - bm, 9) <= -0.005 AND round(oh - bh, 9) <= -0.005 AND round(om - bm, 9) <= -0.005 THEN 'INCONCLUSIVE_REPRESENTATION_BOTTLENECK' WHEN round(om - pm, 9) >= 0.005 AND round(oh - ph, 9) >= -0.005 AND ratio <= 1.5 THEN 'ADOPT_OPTUNA_WINNER'
WHEN round(om - pm, 9) <= -0.005 THEN 'KEEP_PHASE1_BEST' ELSE 'INCONCLUSIVE_REPRESENTATION_BOTTLENECK' END AS verdict FROM f""")
def head_to_head_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    side = lambda a, b: F.struct(((k * a) % 31 / 1000.0).alias("h5"), ((k * b) % 29 / 1000.0).alias("mrr"))
    own = keys(spark, sf).select("k", side(7, 11).alias("b"), side(5, 13).alias("p"), side(3, 17).alias("o"))
    return own.select("k", V.duel_verdict(F.col("b"), F.col("p"), F.col("o"), (k % 9) / 5.0).alias("verdict"))


@query("""WITH f AS (SELECT o_orderkey // 5 AS run, 'v' || (o_orderkey % 5)::VARCHAR AS variant, (o_orderkey * 7 % 11) / 10000.0::DOUBLE AS primary_, (o_orderkey * 3 % 5) / 100.0::DOUBLE AS wmrr, (o_orderkey * 7 % 11 - 4) / 10000.0::DOUBLE AS gain, (o_orderkey % 3 - 1) / 100.0::DOUBLE AS strict, (o_orderkey * 5 % 9 - 6) / 100.0::DOUBLE AS silver, (o_orderkey * 11 % 13 - 9) / 100.0::DOUBLE AS named FROM orders),
g AS (SELECT *, gain >= 0.0005 AND NOT ((silver <= -0.03 OR named <= -0.05) AND strict <= 0) AS good FROM f)
SELECT run, CASE WHEN good THEN variant ELSE 'baseline' END AS best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY good DESC, primary_ DESC, wmrr DESC, variant) AS n FROM g) WHERE n = 1""")
def best_variant(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rows = keys(spark, sf).select(F.floor(k / 5).alias("run"), F.concat(F.lit("v"), (k % 5).cast("string")).alias("variant"), (k * 7 % 11 / 10000.0).alias("primary"), (k * 3 % 5 / 100.0).alias("wmrr"), ((k * 7 % 11 - 4) / 10000.0).alias("primary_delta"), ((k % 3 - 1) / 100.0).alias("strict_delta"), ((k * 5 % 9 - 6) / 100.0).alias("silver_delta"), ((k * 11 % 13 - 9) / 100.0).alias("named_delta"))
    return V.best_variants(rows)


@query("""WITH f AS (SELECT o_orderkey AS k, (o_orderkey * 5 % 13 - 8) / 100.0::DOUBLE AS silver, (o_orderkey * 11 % 17 - 9) / 100.0::DOUBLE AS named, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 3 % 15 - 9) / 100.0::DOUBLE END AS main FROM orders)
SELECT k, concat_ws('|', CASE WHEN silver <= -0.03 THEN 'SILVER_REGRESSION_WARNING' END, CASE WHEN named <= -0.05 THEN 'BUCKET_REGRESSION_WARNING' END, CASE WHEN main <= -0.05 THEN 'MAIN_WORK_REGRESSION_WARNING' END) AS warnings FROM f""")
def guardrail_warnings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    silver, named = (k * 5 % 13 - 8) / 100.0, (k * 11 % 17 - 9) / 100.0
    main = F.when(k % 7 != 0, (k * 3 % 15 - 9) / 100.0)
    return keys(spark, sf).select("k", F.concat_ws("|", V.silver_warnings(silver, named), V.main_work_warning(main)).alias("warnings"))


@query("""WITH f AS (SELECT o_orderkey // 8 AS run, o_orderkey // 4 % 2 AS candidate_k, 0.5::DOUBLE + (o_orderkey % 4) / 10.0::DOUBLE AS weight, (o_orderkey * 7 % 101) / 1000.0::DOUBLE AS p, o_orderkey AS k FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p DESC, k) = 1 AS best FROM f), w AS (SELECT run, candidate_k, weight AS top, p AS most FROM b WHERE best),
n AS (SELECT b.run, weight, top, round(abs(weight - 0.7::DOUBLE), 9) AS away FROM b JOIN w USING (run, candidate_k) WHERE round(abs(most - p), 9) <= 0.02),
g AS (SELECT run, count(*) AS n, arg_min(weight, away * 1000 + weight) AS pick, min(away) AS away, any_value(top) AS top FROM n GROUP BY run)
SELECT run, CASE WHEN n >= 2 THEN pick ELSE top END AS weight, CASE WHEN n < 2 THEN 'NO_PLATEAU_FALLBACK_TO_METRIC_BEST' WHEN away = 0 THEN 'PLATEAU_TIE_BREAK_TO_PREVIOUS_BEST' ELSE 'PLATEAU_TIE_BREAK_NEAREST' END AS policy FROM g""")
def production_weight(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rows = keys(spark, sf).select("k", F.floor(k / 8).alias("run"), (F.floor(k / 4) % 2).alias("candidate_k"), (0.5 + (k % 4) / 10.0).alias("weight"), (k * 7 % 101 / 1000.0).alias("primary"))
    top = rows.groupBy("run").agg(F.max_by("k", F.struct("primary", (-k).alias("k"))).alias("top"))
    return V.plateau_choice(rows.join(top, "run").withColumn("best", k == F.col("top")).drop("top"))


USES = ("SUPPORTED", "PARTIALLY_SUPPORTED", "AMBIGUOUS_QUERY", "NOT_IN_CORPUS")
BUCKETS = ("main_work", "subpage_named", "subpage_generic", "other")


@query(f"""WITH f AS (SELECT o_orderkey AS k, list_filter(['{"','".join(USES)}'], lambda x, i: (o_orderkey // CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 ELSE 7 END) % CASE i WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 9 END = 0) AS u, (o_orderkey % 6) / 5.0::DOUBLE AS w, o_orderkey % 37 = 0 AS absent FROM orders)
SELECT k, CASE WHEN absent OR list_contains(u, 'NOT_IN_CORPUS') THEN 'ABSTAIN_TEST' WHEN NOT list_contains(u, 'SUPPORTED') AND NOT list_contains(u, 'PARTIALLY_SUPPORTED') THEN 'AMBIGUOUS_PROBE' WHEN w <= 0 THEN 'AMBIGUOUS_PROBE' WHEN w >= 0.8 AND NOT list_contains(u, 'AMBIGUOUS_QUERY') AND NOT list_contains(u, 'PARTIALLY_SUPPORTED') THEN 'STRICT_POSITIVE' ELSE 'SOFT_POSITIVE' END AS eval_group FROM f""")
def eval_groups(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    uses = F.array_compact(F.array(*[F.when(F.floor(k / by) % m == 0, F.lit(x)) for x, by, m in zip(USES, (1, 2, 5, 7), (2, 3, 4, 9), strict=True)]))
    return keys(spark, sf).select("k", V.eval_group(uses, (k % 6) / 5.0, k % 37 == 0).alias("eval_group"))


@query(f"""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 23 = 0 THEN 'ABSTAIN_TEST' ELSE 'STRICT_POSITIVE' END AS g, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS hit, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 3 = 0 END AS page, ['{"','".join(BUCKETS)}'][o_orderkey % 4 + 1] AS bucket, CASE WHEN o_orderkey % 2 = 0 THEN 'ambiguous' ELSE 'direct' END AS kind,
CASE o_orderkey // 3 % 5 WHEN 0 THEN 'Blue Star 2기' WHEN 1 THEN 'Blue Star' ELSE 'Red ' || (o_orderkey % 7)::VARCHAR END AS wanted, CASE o_orderkey // 5 % 5 WHEN 0 THEN 'Blue Star 2기' WHEN 1 THEN 'Blue' WHEN 2 THEN '' ELSE 'Red ' || (o_orderkey % 7)::VARCHAR END AS got FROM orders)
SELECT k, CASE WHEN g = 'ABSTAIN_TEST' THEN 'NOT_IN_CORPUS_CASE' WHEN hit = 1 OR page IS NULL THEN 'UNKNOWN' WHEN page AND bucket = 'subpage_named' AND k % 4 < 3 THEN 'NAMED_SUBPAGE_MISS' WHEN page THEN 'SECTION_MISS' WHEN got <> '' AND got = wanted THEN CASE WHEN contains(wanted, '기') THEN 'WRONG_SEASON' ELSE 'WRONG_SERIES' END
WHEN got <> '' AND (contains(got, wanted) OR contains(wanted, got)) THEN 'WRONG_SERIES' WHEN bucket = 'subpage_named' THEN 'NAMED_SUBPAGE_MISS' WHEN bucket = 'subpage_generic' THEN 'SUBPAGE_MISS' WHEN bucket = 'main_work' AND kind = 'ambiguous' THEN 'OVER_BROAD_QUERY' WHEN bucket = 'main_work' THEN 'TITLE_MISS' ELSE 'UNKNOWN' END AS reason FROM f""")
def gold_miss_reasons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    red = F.concat(F.lit("Red "), (k % 7).cast("string"))
    n, m = F.floor(k / 3) % 5, F.floor(k / 5) % 5
    wanted = F.when(n == 0, "Blue Star 2기").when(n == 1, "Blue Star").otherwise(red)
    got = F.when(m == 0, "Blue Star 2기").when(m == 1, "Blue").when(m == 2, "").otherwise(red)
    path = F.when(k % 4 < 3, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    group, bucket = F.when(k % 23 == 0, "ABSTAIN_TEST").otherwise("STRICT_POSITIVE"), F.element_at(F.array(*map(F.lit, BUCKETS)), (k % 4 + 1).cast("int"))
    reason = V.miss_reason(group, F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 11 != 0, k % 3 == 0), path, bucket, F.when(k % 2 == 0, "ambiguous").otherwise("direct"), wanted, got)
    return keys(spark, sf).select("k", reason.alias("reason"))


def run_side(a: int) -> Column:
    k = F.col("k")
    r = lambda m, s=0: (k * a + s) % m
    return F.struct((r(17) != 0).alias("ok"), (r(7) == 0).alias("hit_1"), (r(5) == 0).alias("hit_3"), (r(3) == 0).alias("hit_5"), (r(4) / 4.0).alias("mrr"), (r(2) == 0).alias("keyword"), r(6).alias("candidates"), r(4, 1).alias("docs"), (r(11) * 10.0).alias("ms"), r(3, 1).alias("llm_calls"), r(3, 2).alias("calls"))


def run_side_sql(t: str, a: int) -> str:
    r = lambda m, s=0: f"((k * {a} + {s}) % {m})"
    return f"{r(17)} <> 0 AS {t}ok, {r(7)} = 0 AS {t}1, {r(5)} = 0 AS {t}3, {r(3)} = 0 AS {t}5, {r(4)} / 4.0::DOUBLE AS {t}m, {r(2)} = 0 AS {t}w, {r(6)} AS {t}c, {r(4, 1)} AS {t}d, {r(11)} * 10.0::DOUBLE AS {t}ms, {r(3, 1)} AS {t}l, {r(3, 2)} AS {t}calls"


PAIRS = f"""f AS (SELECT k, k % 3 <> 0 AS doc, k % 4 <> 0 AS word, {run_side_sql('o', 3)}, {run_side_sql('n', 5)} FROM (SELECT o_orderkey AS k FROM orders)),
q AS (SELECT *, coalesce(nullif(CASE WHEN doc THEN n1::INT - o1::INT ELSE 0 END, 0), nullif(CASE WHEN doc THEN n3::INT - o3::INT ELSE 0 END, 0), nullif(CASE WHEN doc THEN n5::INT - o5::INT ELSE 0 END, 0), nullif(CASE WHEN doc THEN sign(nm - om)::INT ELSE 0 END, 0), nullif(CASE WHEN word THEN nw::INT - ow::INT ELSE 0 END, 0),
  CASE WHEN nc > oc + 1 THEN 1 WHEN nc + 1 < oc THEN -1 END, CASE WHEN nd > od THEN 1 WHEN nd < od THEN -1 ELSE 0 END) AS gain, CASE WHEN oms > 0 THEN nms / oms ELSE 1.0::DOUBLE END AS ratio FROM f),
v AS (SELECT *, CASE WHEN ook AND NOT nok THEN 'regression' WHEN nok AND NOT ook THEN 'graph_win' WHEN NOT nok THEN 'tie' WHEN gain > 0 THEN 'graph_win' WHEN gain < 0 THEN 'regression' WHEN (nl > ol OR ncalls > ocalls) AND ratio > 1.2 THEN 'legacy_win' WHEN ratio > 2 THEN 'regression' WHEN ratio < 0.8 THEN 'graph_win' ELSE 'tie' END AS verdict FROM q)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    own = keys(spark, sf).select("k", run_side(3).alias("o"), run_side(5).alias("n"))
    return own.withColumn("verdict", V.pair_verdict(F.col("o"), F.col("n"), k % 3 != 0, k % 4 != 0))


@query(f"WITH {PAIRS} SELECT k, verdict FROM v")
def paired_run_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("k", "verdict")


@query(f"""WITH {PAIRS}, s AS (SELECT k % 40 AS slice, count(*) FILTER (WHERE verdict = 'regression') AS regressions, count(*) FILTER (WHERE verdict = 'graph_win') AS wins, avg(ook::INT) AS osucc, avg(nok::INT) AS nsucc, avg(o5::INT) AS oh, avg(n5::INT) AS nh, avg(om) AS om, avg(nm) AS nm, avg(ol) AS ol, avg(nl) AS nl, avg(ocalls) AS ocalls, avg(ncalls) AS ncalls, quantile_disc(oms, 0.95) AS op, quantile_disc(nms, 0.95) AS np FROM v GROUP BY 1)
SELECT slice, regressions, wins, round(osucc, 6) AS old_success, round(nsucc, 6) AS new_success, CASE WHEN nsucc + 0.005 < osucc THEN 'hold_review_errors' WHEN regressions > 2 * wins THEN 'hold_review_regressions' WHEN nh - oh >= 0.005 OR nm - om >= 0.005 THEN CASE WHEN np / op <= 1.5 THEN 'adopt_candidate' ELSE 'hold_review_regressions' END WHEN nl > ol OR ncalls > ocalls THEN 'hold_no_quality_gain' ELSE 'hold_experimental_backend_only' END AS recommendation FROM s""")
def paired_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """By slice of the queries, whether to adopt the new run; more than two regressions for each gain count as one."""
    k = F.col("k")
    rows = pairs(spark, sf)
    slice_ = (k % 40).alias("slice")
    late = [quantiles.nearest_ranks(rows.select(slice_, F.col(c).ms.alias("ms")), "slice", "ms", {f"p95_{c}": 0.95}) for c in ("o", "n")]
    side = lambda c: F.struct(F.avg(F.col(c).ok.cast("int")).alias("success"), F.avg(F.col(c).llm_calls).alias("llm_calls"), F.avg(F.col(c).calls).alias("calls"), F.avg(F.col(c).hit_5.cast("int")).alias("h5"), F.avg(F.col(c).mrr).alias("mrr"))
    s = rows.groupBy(slice_).agg(F.count_if(F.col("verdict") == "regression").alias("regressions"), F.count_if(F.col("verdict") == "graph_win").alias("wins"), side("o").alias("o"), side("n").alias("n"))
    s = s.join(late[0], "slice").join(late[1], "slice").withColumns({c: F.col(c).withField("p95", F.col(f"p95_{c}")) for c in ("o", "n")})
    lift = (F.col("n.h5") - F.col("o.h5") >= V.EPS) | (F.col("n.mrr") - F.col("o.mrr") >= V.EPS)
    more = F.greatest(F.col("regressions") - 2 * F.col("wins"), F.lit(0))
    return s.select("slice", "regressions", "wins", F.round("o.success", 6).alias("old_success"), F.round("n.success", 6).alias("new_success"), V.recommendation(F.col("o"), F.col("n"), more, lift).alias("recommendation"))


ACTIONS = ("ANSWER", "ANSWER_WITH_CAUTION", "ASK_CLARIFICATION", "QUERY_REWRITE", "HYBRID_RECOVERY", "INSUFFICIENT_EVIDENCE", "OTHER")


@query(f"""WITH f AS (SELECT item_id AS query_id, ['{"','".join(ACTIONS)}'][item_id % 7 + 1] AS action, 'q' || item_id::VARCHAR AS q, CASE WHEN item_id % 3 = 0 THEN 'Alpha / One' WHEN item_id % 3 = 1 THEN 'beta' END AS wanted, ['Alpha > one', 'Beta', '', 'beta ', 'Gamma · ' || (item_id % 5)::VARCHAR] AS titles FROM benchmark),
m AS (SELECT *, unnest(CASE WHEN action = 'QUERY_REWRITE' THEN ['oracle', 'production_like'] ELSE [NULL] END) AS mode FROM f),
t AS (SELECT *, list_filter(['Alpha > one', 'Beta', titles[5]], lambda x, i: wanted IS NULL OR NOT (i = 1 AND query_id % 3 = 0) AND NOT (i = 2 AND query_id % 3 = 1)) AS terms FROM m)
SELECT query_id, mode, CASE action WHEN 'ANSWER' THEN 'NOOP' WHEN 'ANSWER_WITH_CAUTION' THEN 'SKIP_CAUTION' WHEN 'QUERY_REWRITE' THEN 'ATTEMPT_REWRITE' WHEN 'HYBRID_RECOVERY' THEN 'ATTEMPT_HYBRID' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'SKIP_REFUSE' ELSE 'SKIP_DEFER' END AS plan,
CASE action WHEN 'ANSWER' THEN 'ALREADY_CONFIDENT' WHEN 'ANSWER_WITH_CAUTION' THEN 'CAUTION_NOT_RECOVERED_THIS_PHASE' WHEN 'QUERY_REWRITE' THEN NULL WHEN 'HYBRID_RECOVERY' THEN NULL WHEN 'INSUFFICIENT_EVIDENCE' THEN 'REFUSED_INSUFFICIENT_EVIDENCE' ELSE 'CLARIFICATION_DEFERRED_THIS_PHASE' END AS reason,
CASE WHEN mode = 'oracle' THEN q || ' | ' || array_to_string(list_concat(CASE WHEN wanted IS NULL THEN [] ELSE [wanted] END, terms), ' ') WHEN mode IS NOT NULL THEN q || ' | ' || array_to_string(terms, ' ') WHEN action = 'HYBRID_RECOVERY' THEN q END AS text, coalesce(mode = 'oracle', false) AS upper_bound FROM t""")
def recovery_attempts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    wanted = F.when(i % 3 == 0, "Alpha / One").when(i % 3 == 1, "beta")
    titles = F.array(F.lit("Alpha > one"), F.lit("Beta"), F.lit(""), F.lit("beta "), F.concat(F.lit("Gamma · "), (i % 5).cast("string")))
    own = table(spark, sf, "benchmark").select(i.alias("query_id"), F.concat(F.lit("q"), i.cast("string")).alias("query"), wanted.alias("wanted"), titles.alias("titles"), F.element_at(F.array(*map(F.lit, ACTIONS)), (i % 7 + 1).cast("int")).alias("action"))
    return V.attempts(own)


@query("""WITH f AS (SELECT o_orderkey % 2 = 0 AS d, o_orderkey % 3 = 0 AS b, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 < 4 END AS r FROM orders WHERE o_orderkey % 11 <> 0),
g AS (SELECT CASE WHEN NOT d AND b THEN 'dense_miss_to_boost_hit' WHEN d AND NOT b THEN 'dense_hit_to_boost_miss' WHEN b AND r = false THEN 'boost_hit_rerank_miss' WHEN b AND r THEN 'boost_hit_rerank_hit' WHEN NOT d AND NOT b THEN 'both_miss' ELSE 'neutral' END AS trajectory FROM f)
SELECT trajectory, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS ratio FROM g GROUP BY 1""")
def boost_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Three lists by query joined, queries that the dense or boosted list lacks left out."""
    k = F.col("k")
    own = keys(spark, sf)
    dense, boost = own.select("k", (k % 2 == 0).alias("d")), own.where(k % 11 != 0).select("k", (k % 3 == 0).alias("b"))
    rerank = own.where(k % 5 != 0).select("k", (k % 7 < 4).alias("r"))
    rows = dense.join(boost, "k").join(rerank, "k", "left").groupBy(V.boost_group(F.col("d"), F.col("b"), F.col("r")).alias("trajectory")).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total")))).select("trajectory", "n", F.round(F.col("n") / F.col("total"), 4).alias("ratio"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN ' 2 ' WHEN 1 THEN 'fully_answerable' WHEN 2 THEN '7' WHEN 3 THEN '' WHEN 4 THEN 'Not_Relevant' ELSE '1' END AS v FROM orders)
SELECT k, CASE k % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 0 WHEN 5 THEN 1 END AS label FROM f""")
def parsed_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    text = F.element_at(F.array(*map(F.lit, (" 2 ", "fully_answerable", "7", "", "Not_Relevant", "1"))), (k % 6 + 1).cast("int"))
    return keys(spark, sf).select("k", V.answerability(text).alias("label"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 20) / 20.0::DOUBLE END AS v, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 3 % 20) / 20.0::DOUBLE END AS b FROM orders)
SELECT k, CASE WHEN v IS NULL THEN 'required' WHEN b IS NULL THEN 'baseline required' WHEN round(v - b + 0.05, 9) < 0 THEN 'below baseline' END AS reason FROM f""")
def baseline_deltas(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    value, base = F.when(k % 13 != 0, (k % 20) / 20.0), F.when(k % 17 != 0, (k * 3 % 20) / 20.0)
    return keys(spark, sf).select("k", V.below_baseline(value, base, F.lit(-0.05)).alias("reason"))
