"""Verdicts as ordered rules over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: hard reasons of the confidence verdict, and actions from weakest to strongest.
HARD = ("LOW_TOP1_SCORE", "INSUFFICIENT_EVIDENCE", "PAGE_ID_DISAGREEMENT", "RERANK_DEMOTED_GOLD", "TITLE_ALIAS_MISMATCH", "GOLD_NOT_IN_CANDIDATES")
ACTIONS = ("ANSWER", "ANSWER_WITH_CAUTION", "ASK_CLARIFICATION", "QUERY_REWRITE", "HYBRID_RECOVERY", "INSUFFICIENT_EVIDENCE")


def first_rule(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def all_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]))


def confidence_label(reasons: Column, gold_missing: Column) -> Column:
    hard = F.arrays_overlap(reasons, F.array(*map(F.lit, HARD)))
    return first_rule([(gold_missing, "FAILED"), (hard, "LOW_CONFIDENCE"), (F.size(reasons) > 0, "AMBIGUOUS")], "CONFIDENT")


def strongest(actions: Column) -> Column:
    """The strongest of an array of actions; the weakest of all for an empty one."""
    rank = F.create_map(*[y for i, x in enumerate(ACTIONS) for y in (F.lit(x), F.lit(i))])
    return F.element_at(F.array(*map(F.lit, ACTIONS)), F.coalesce(F.array_max(F.transform(actions, lambda x: rank[x])), F.lit(0)) + 1)


def overlap_risk(title: Column, chunk: Column, bm25_rank: Column) -> Column:
    return first_rule([(title.isNull() & chunk.isNull(), "not_applicable"), ((title >= 0.55) | (chunk >= 0.35) | (bm25_rank <= 3), "high"), ((title >= 0.30) | (chunk >= 0.20) | (bm25_rank <= 10), "medium")], "low")


def rank_delta(before: Column, after: Column, k: int) -> Column:
    """How far a gold result moved, null ranks being beyond k: null if it is missed both times."""
    return F.when(before.isNull() & after.isNull(), None).when(before.isNull(), -(k + 1 - after)).when(after.isNull(), k + 1 - before).otherwise(after - before)
