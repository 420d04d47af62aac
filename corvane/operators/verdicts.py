"""Verdicts over deltas of experiments, gold labels and paired runs, as ordered rules over columns.

A struct of deltas has h5, mrr, c50, c100 (candidate minus anchor; null where unknown) and ratio (of the 95th percentiles of latency).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.decisions import all_reasons, first_rule

#: Fixed: the least gains that count, and the latency ratio that a gain may cost.
EPS, LATENCY = 0.005, 1.5
#: Fixed: floors of the cap comparison.
RELATION_FLOOR, CAPPED_DROP = 0.45, 5
#: Fixed: the gain of duplicates that asks for other chunks.
CROWDED = 0.01
#: Fixed: losses that warn, the least gain of the primary score, and the width of a plateau.
SILVER_LOSS, BUCKET_LOSS, MAIN_LOSS, PRIMARY_GAIN, PLATEAU = 0.03, 0.05, 0.05, 0.0005, 0.02
#: Fixed: verdicts of cap policies, in order of preference among equals.
CAPS = {"doc_id_cap": "ADOPT_DOC_ID_LEVEL_CAP", "no_cap": "ADOPT_NO_CAP_RERANK_INPUT", "title_cap_2": "ADOPT_TITLE_CAP_RERANK_INPUT_2", "title_cap_3": "ADOPT_TITLE_CAP_RERANK_INPUT_3", "section_path_cap": "ADOPT_DOC_ID_LEVEL_CAP"}
#: Fixed: verdicts of passage formats, in order of preference among equals.
FORMATS = {"title_section_plus_chunk": "ADOPT_RERANKER_TITLE_SECTION_PREFIX", "title_plus_chunk": "ADOPT_RERANKER_TITLE_PREFIX", "compact_metadata_plus_chunk": "ADOPT_COMPACT_METADATA_PREFIX"}
#: Fixed: labels of answerability, by number.
ANSWERABILITY = ("NOT_RELEVANT", "RELATED_BUT_NOT_ANSWERABLE", "PARTIALLY_ANSWERABLE", "FULLY_ANSWERABLE")


def holds(condition: Column) -> Column:
    """False where a comparison has a null side."""
    return F.coalesce(condition, F.lit(False))


def delta(after: Column, before: Column) -> Column:
    """Null if either side is."""
    return F.round(after - before, 6)


def lifted(d: Column) -> Column:
    return (holds(d.h5 >= EPS) | holds(d.mrr >= EPS)) & F.coalesce(d.h5 >= -EPS, F.lit(True))


def regressed(d: Column) -> Column:
    return holds(d.h5 <= -EPS) | holds(d.mrr <= -EPS) | holds(d.c50 <= -EPS)


def affordable(d: Column) -> Column:
    return F.coalesce(d.ratio <= LATENCY, F.lit(True))


def pool_only(d: Column) -> Column:
    """The candidate pool gains, the final ranking doesn't."""
    return (holds(d.c50 >= EPS) | holds(d.c100 >= EPS)) & F.coalesce(d.h5 < EPS, F.lit(True)) & F.coalesce(d.mrr < EPS, F.lit(True))


def score(d: Column) -> Column:
    return F.coalesce(d.h5, F.lit(0.0)) + F.coalesce(d.mrr, F.lit(0.0))


def grade(d: Column, anchor: Column) -> Column:
    gains = holds(d.h5 >= EPS) | holds(d.mrr >= EPS)
    flat = F.coalesce(F.abs(d.h5) < EPS, F.lit(True)) & F.coalesce(F.abs(d.mrr) < EPS, F.lit(True))
    return first_rule([(anchor, "baseline"), (regressed(d), "regression"), (gains & ~affordable(d), "diagnostic_only"), (gains, "promising_quality"), (flat & holds(d.c50 >= EPS), "diagnostic_only"), (flat, "inconclusive")], "diagnostic_only")


def index_verdict(title: Column, section: Column) -> Column:
    """Which text of titles and sections to embed; title and section are structs of deltas, null where a variant wasn't run."""
    ok = lambda d: d.isNotNull() & holds(lifted(d)) & ~holds(regressed(d)) & holds(affordable(d))
    weak = ~holds(lifted(section)) | holds(regressed(section))
    pools = (section.isNotNull() & holds(pool_only(section))) | (title.isNotNull() & holds(pool_only(title)))
    return first_rule([(ok(section), "ADOPT_TITLE_SECTION_INDEX"), (ok(title) & (section.isNull() | weak), "ADOPT_TITLE_INDEX"), (pools, "NEED_RERANKER_INPUT_AUDIT_FIRST")], "KEEP_RAW_INDEX")


def cap_verdicts(rows: DataFrame, by: str = "run", anchor: str = "title_cap_1") -> DataFrame:
    """run, verdict over rows (run, policy, d, dup, relation_h5, capped_out), dup being the delta of duplicates in the first ten."""
    d = F.col("d")
    ok = (F.col("policy") != anchor) & lifted(d) & ~regressed(d) & affordable(d)
    rows = rows.select("*", ok.alias("ok"), F.round(score(d), 9).alias("s"), F.coalesce("dup", F.lit(0.0)).alias("less"))
    lead = F.max(F.when(F.col("ok"), F.struct("s", (-F.col("less")).alias("dup"), "policy")))
    own = lambda p: F.max(F.when(F.col("ok") & (F.col("policy") == p), F.col("s")))
    anchored = F.max(F.when(F.col("policy") == anchor, F.col("capped_out")))
    low = F.bool_and(holds(F.col("relation_h5") < RELATION_FLOOR))
    found = rows.groupBy(by).agg(lead.alias("lead"), own("doc_id_cap").alias("doc"), own("no_cap").alias("none"), low.alias("low"), F.greatest(F.coalesce(anchored - F.min("capped_out"), F.lit(0)), F.lit(0)).alias("drop"))
    names = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    near = lambda c, p: (F.col("lead.policy") != p) & holds(F.round(F.col("lead.s") - F.col(c), 9) <= EPS)
    leader = first_rule([(near("doc", "doc_id_cap"), F.lit("doc_id_cap")), (near("none", "no_cap"), F.lit("no_cap"))], F.col("lead.policy"))
    poor = F.col("low") & (F.col("drop") < CAPPED_DROP)
    return found.select(by, F.when(F.col("lead").isNotNull(), names[leader]).when(poor, "NEED_SCHEMA_ENRICHMENT").otherwise("KEEP_TITLE_CAP_RERANK_INPUT_1").alias("verdict"))


def format_verdicts(rows: DataFrame, by: str = "run") -> DataFrame:
    """run, verdict over rows (run, variant, format, d, dup); a format is judged by its best pair, a passing one before others."""
    d = F.col("d")
    passing = ~regressed(d) & affordable(d)
    order = F.struct(passing.cast("int").alias("p"), F.round(score(d), 9).alias("s"), (lifted(d) & passing).cast("int").alias("ok"))
    best = lambda f: F.max(F.when(F.col("format") == f, order))
    plain = (F.col("format") == "chunk_only") & (F.col("variant") != "raw")
    moved = F.bool_or(plain & (holds(d.c50 >= EPS) | holds(d.c100 >= EPS)))
    dense = F.bool_or((F.col("format") != "chunk_only") & holds(F.col("dup") >= CROWDED))
    found = rows.groupBy(by).agg(*[best(f).alias(f) for f in FORMATS], moved.alias("moved"), dense.alias("dense"))
    each = F.array_compact(F.array(*[F.when(holds(F.col(f).ok == 1), F.struct(F.col(f).s.alias("s"), F.lit(-i).alias("i"), F.lit(v).alias("v"))) for i, (f, v) in enumerate(FORMATS.items())]))
    rest = F.when(holds(F.col("moved")) & holds(F.col("dense")), "NEED_CHUNKING_DIVERSITY_EXPERIMENT").otherwise("KEEP_CHUNK_ONLY_RERANKER_INPUT")
    return found.select(by, F.coalesce(F.array_max(each).v, rest).alias("verdict"))


def duel_verdict(base: Column, first: Column, tuned: Column, ratio: Column) -> Column:
    """The first phase's best against the tuned one; the three are structs of h5 and mrr, ratio the tuned one's latency to the base."""
    loses = lambda x: holds(F.round(x.h5 - base.h5, 9) <= -EPS) & holds(F.round(x.mrr - base.mrr, 9) <= -EPS)
    gain, h5 = F.round(tuned.mrr - first.mrr, 9), F.round(tuned.h5 - first.h5, 9)
    unclear = "INCONCLUSIVE_REPRESENTATION_BOTTLENECK"
    return first_rule([(loses(first) & loses(tuned), unclear), (holds(gain >= EPS) & F.coalesce(h5 >= -EPS, F.lit(True)) & F.coalesce(ratio <= LATENCY, F.lit(True)), "ADOPT_OPTUNA_WINNER"), (holds(gain <= -EPS), "KEEP_PHASE1_BEST")], unclear)


def silver_warnings(all_delta: Column, named_delta: Column) -> Column:
    return all_reasons([(holds(all_delta <= -SILVER_LOSS), "SILVER_REGRESSION_WARNING"), (holds(named_delta <= -BUCKET_LOSS), "BUCKET_REGRESSION_WARNING")])


def main_work_warning(main_delta: Column) -> Column:
    return F.when(holds(main_delta <= -MAIN_LOSS), F.lit("MAIN_WORK_REGRESSION_WARNING"))


def best_variants(rows: DataFrame, by: str = "run") -> DataFrame:
    """run, best over candidates (run, variant, primary, wmrr, and the deltas primary_delta, strict_delta, silver_delta, named_delta); the baseline if none survives."""
    warned = F.size(silver_warnings(F.col("silver_delta"), F.col("named_delta"))) > 0
    good = (F.col("primary_delta") >= PRIMARY_GAIN) & ~(warned & (F.col("strict_delta") <= 0))
    w = Window.partitionBy(by).orderBy(F.desc(good), F.desc("primary"), F.desc("wmrr"), "variant")
    first = rows.select("*", good.alias("good"), F.row_number().over(w).alias("n")).where("n = 1")
    return first.select(by, F.when(F.col("good"), F.col("variant")).otherwise("baseline").alias("best"))


def plateau_choice(rows: DataFrame, by: str = "run", prefer: float = 0.70, width: float = PLATEAU) -> DataFrame:
    """run, weight, policy over a grid (run, candidate_k, weight, primary, best: whether it is the winner): on a plateau beside the winner the
    preferred weight, or that nearest to it."""
    win = rows.where("best").select(by, "candidate_k", F.col("weight").alias("top"), F.col("primary").alias("most"))
    near = rows.join(win, [by, "candidate_k"]).where(F.round(F.abs(F.col("most") - F.col("primary")), 9) <= width)
    away = F.round(F.abs(F.col("weight") - prefer), 9)
    found = near.groupBy(by).agg(F.count("*").alias("n"), F.min(F.struct(away.alias("away"), "weight")).alias("pick"), F.first("top").alias("top"))
    weight = F.when(F.col("n") >= 2, F.col("pick.weight")).otherwise(F.col("top"))
    policy = first_rule([(F.col("n") < 2, "NO_PLATEAU_FALLBACK_TO_METRIC_BEST"), (F.col("pick.away") == 0, "PLATEAU_TIE_BREAK_TO_PREVIOUS_BEST")], "PLATEAU_TIE_BREAK_NEAREST")
    return found.select(by, weight.alias("weight"), policy.alias("policy"))


def eval_group(uses: Column, weight: Column, absent: Column) -> Column:
    """The group of a gold row by its labels (an array of upper-case words), weight, and whether the corpus is known to lack the answer."""
    has = lambda x: F.array_contains(uses, x)
    weight = F.coalesce(weight, F.lit(0.0))
    none = ~has("SUPPORTED") & ~has("PARTIALLY_SUPPORTED")
    return first_rule([(holds(absent) | has("NOT_IN_CORPUS"), "ABSTAIN_TEST"), (none | (weight <= 0), "AMBIGUOUS_PROBE"), ((weight >= 0.8) & ~has("AMBIGUOUS_QUERY") & ~has("PARTIALLY_SUPPORTED"), "STRICT_POSITIVE")], "SOFT_POSITIVE")


def miss_reason(group: Column, hit: Column, page_hit: Column, path: Column, bucket: Column, kind: Column, wanted: Column, got: Column) -> Column:
    """Why a gold row failed, by its first result: whether that has the page (null without results), its title and the wanted one, bucket and type."""
    bucket, kind = F.lower(F.coalesce(bucket, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    wanted, got = F.trim(F.coalesce(wanted, F.lit(""))), F.coalesce(got, F.lit(""))
    titled = (wanted != "") & (got != "")
    same = titled & (F.trim(got) == wanted)
    season = F.contains(wanted, F.lit("기")) | F.contains(wanted, F.lit("시즌"))
    named = bucket == "subpage_named"
    return first_rule([
        (group == "ABSTAIN_TEST", "NOT_IN_CORPUS_CASE"),
        (holds(hit == 1) | page_hit.isNull(), "UNKNOWN"),
        (page_hit & (F.size(path) > 0) & named, "NAMED_SUBPAGE_MISS"),
        (page_hit, "SECTION_MISS"),
        (same & season, "WRONG_SEASON"),
        (same | (titled & (F.contains(got, wanted) | F.contains(wanted, got))), "WRONG_SERIES"),
        (named, "NAMED_SUBPAGE_MISS"),
        (bucket == "subpage_generic", "SUBPAGE_MISS"),
        ((bucket == "main_work") & kind.isin("ambiguous", "indirect_entity"), "OVER_BROAD_QUERY"),
        (bucket == "main_work", "TITLE_MISS"),
    ], "UNKNOWN")


def quality_sign(old: Column, new: Column, doc: Column, words: Column) -> Column:
    """1, 0 or -1: whether the new run finds more. Structs have hit_1, hit_3, hit_5, mrr, keyword, candidates and docs; doc and words say what the row can be judged by."""
    sign = lambda a, b: F.when(a > b, 1).when(a < b, -1).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    mrr = F.coalesce(new.mrr, F.lit(0.0)) - F.coalesce(old.mrr, F.lit(0.0))
    steps = [F.when(doc, sign(flag(new[f"hit_{k}"]), flag(old[f"hit_{k}"]))).otherwise(0) for k in (1, 3, 5)]
    steps += [F.when(doc & (mrr > 1e-6), 1).when(doc & (mrr < -1e-6), -1).otherwise(0), F.when(words, sign(flag(new.keyword), flag(old.keyword))).otherwise(0)]
    steps += [F.when(new.candidates > old.candidates + 1, 1).when(new.candidates + 1 < old.candidates, -1).otherwise(0), sign(new.docs, old.docs)]
    return F.coalesce(*[F.nullif(s, F.lit(0)) for s in steps], F.lit(0))


def pair_verdict(old: Column, new: Column, doc: Column, words: Column) -> Column:
    """Of two runs of a query; structs have also ok, ms, llm_calls and calls."""
    ratio = F.when(old.ms > 0, new.ms / old.ms).otherwise(F.lit(1.0))
    gain = quality_sign(old, new, doc, words)
    dearer = (new.llm_calls > old.llm_calls) | (new.calls > old.calls)
    return first_rule([(~new.ok & old.ok, "regression"), (new.ok & ~old.ok, "graph_win"), (~new.ok & ~old.ok, "tie"), (gain > 0, "graph_win"), (gain < 0, "regression"), (dearer & (ratio > 1.2), "legacy_win"), (ratio > 2.0, "regression"), (ratio < 0.8, "graph_win")], "tie")


def recommendation(old: Column, new: Column, regressions: Column, lifted_: Column) -> Column:
    """Of a whole comparison; structs have success, p95, llm_calls and calls (means)."""
    ratio = F.when(old.p95 > 0, new.p95 / old.p95).otherwise(F.lit(1.0))
    dearer = holds(new.llm_calls > old.llm_calls) | holds(new.calls > old.calls)
    return first_rule([(holds(new.success + EPS < old.success), "hold_review_errors"), (regressions > 0, "hold_review_regressions"), (lifted_ & (ratio <= LATENCY), "adopt_candidate"), (lifted_, "hold_review_regressions"), (dearer, "hold_no_quality_gain")], "hold_experimental_backend_only")


def recovery_action(action: Column) -> Column:
    """(action, reason): what is tried for a verdict's action, or why nothing is."""
    rules = [("INSUFFICIENT_EVIDENCE", "SKIP_REFUSE", "REFUSED_INSUFFICIENT_EVIDENCE"), ("ANSWER_WITH_CAUTION", "SKIP_CAUTION", "CAUTION_NOT_RECOVERED_THIS_PHASE"), ("ASK_CLARIFICATION", "SKIP_DEFER", "CLARIFICATION_DEFERRED_THIS_PHASE"), ("ANSWER", "NOOP", "ALREADY_CONFIDENT"), ("HYBRID_RECOVERY", "ATTEMPT_HYBRID", None), ("QUERY_REWRITE", "ATTEMPT_REWRITE", None)]
    out = F.struct(F.lit("SKIP_DEFER").alias("action"), F.lit("CLARIFICATION_DEFERRED_THIS_PHASE").alias("reason"))
    for name, plan, reason in rules:
        out = F.when(action == name, F.struct(F.lit(plan).alias("action"), F.lit(reason).cast("string").alias("reason"))).otherwise(out)
    return out


def plain_title(title: Column) -> Column:
    """A title in lower case, its separators and white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), "[/>·]", " "), r"\s+", " "))


def rewritten(query: Column, wanted: Column, titles: Column, oracle: bool) -> Column:
    """query | terms: distinct titles of the candidates in order. The oracle's begin with the wanted title, others never have it; null without terms."""
    plain = F.transform(titles, lambda x: F.struct(plain_title(x).alias("k"), x.alias("t")))
    wanted_key = plain_title(wanted)
    known = F.filter(plain, lambda x: (x.k != "") & ((x.k != wanted_key) | (wanted_key == "")))
    keys = F.array_distinct(F.transform(known, lambda x: x.k))
    firsts = F.transform(keys, lambda k: F.element_at(F.filter(known, lambda x: x.k == k), 1).t)
    terms = F.concat(F.when(wanted_key != "", F.array(wanted)).otherwise(F.array().cast("array<string>")), firsts) if oracle else firsts
    return F.when(F.size(terms) > 0, F.concat(query, F.lit(" | "), F.array_join(terms, " ")))


def attempts(verdicts: DataFrame, modes: tuple[str, ...] = ("oracle", "production_like")) -> DataFrame:
    """A row for each attempt of verdicts (query_id, query, wanted, titles, action): a rewrite is tried in each mode, the rest once."""
    plan = recovery_action(F.col("action"))
    mode = F.when(F.col("action") == "QUERY_REWRITE", F.array(*map(F.lit, modes))).otherwise(F.array(F.lit(None).cast("string")))
    out = verdicts.select("*", plan.alias("plan"), F.explode(mode).alias("mode"))
    text = F.when(F.col("mode") == "oracle", rewritten(F.col("query"), F.col("wanted"), F.col("titles"), True)).when(F.col("mode").isNotNull(), rewritten(F.col("query"), F.col("wanted"), F.col("titles"), False))
    return out.select("query_id", "mode", F.col("plan.action").alias("plan"), F.col("plan.reason").alias("reason"), F.coalesce(text, F.when(F.col("plan.action").startswith("ATTEMPT"), F.col("query"))).alias("text"), (F.coalesce("mode", F.lit("")) == "oracle").alias("upper_bound"))


def boost_group(dense: Column, boost: Column, rerank: Column) -> Column:
    """Where a query's gold went from the dense over the boosted to the reranked list; rerank is null without one."""
    return first_rule([(~dense & boost, "dense_miss_to_boost_hit"), (dense & ~boost, "dense_hit_to_boost_miss"), (boost & holds(~rerank), "boost_hit_rerank_miss"), (boost & holds(rerank), "boost_hit_rerank_hit"), (~dense & ~boost, "both_miss")], "neutral")


def answerability(value: Column) -> Column:
    """The number of a label from itself as text or from its name in any case; null for anything else."""
    text = F.upper(F.trim(value))
    names = F.create_map(*[y for i, x in enumerate(ANSWERABILITY) for y in (F.lit(x), F.lit(i))])
    return F.coalesce(F.when(text.rlike("^[0-3]$"), text.cast("int")), names[text])


def below_baseline(value: Column, base: Column, allowed: Column) -> Column:
    """Why a metric fails beside its baseline; null if it doesn't."""
    return F.when(value.isNull(), "required").when(base.isNull(), "baseline required").when(F.round(value - base - allowed, 9) < 0, "below baseline")
