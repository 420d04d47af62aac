"""Registration of queries with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def neighbours_sql(k: int = 10, dims: int = 64, name: str = "h", where: str = "TRUE") -> str:
    """CTEs up to `name`: the k nearest of every query vector (ids divisible by 20) among the vectors that fit."""
    return f"""{name}_e AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, {dims}) AS v FROM embeddings),
{name}_s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(q.v, e.v), 6) AS score, q.label AS q_label, e.label AS label
  FROM {name}_e q JOIN {name}_e e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 AND {where}),
{name} AS (SELECT *, q_label = label AS gold FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""
