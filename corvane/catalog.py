"""Registered queries of the retrieval engine and the SQL that each must agree with."""

from __future__ import annotations

from corvane.plans import catalogue, evaluation, gold, golden, indexes, loops, reports, rounds, samplers, search, sheets, studies, summaries, texts, units, verdicts  # noqa: F401
from corvane.plans.registry import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
FLAGSHIP = "bm25_topk"
