"""Exact quantiles against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import run_reports
from corvane.operators.quantiles import linear, nearest_ranks, rounded_ranks


@pytest.mark.parametrize("bins", [2, 7, 128])
def test_against_sorting(spark, bins):
    draw = random.Random(bins)
    groups = {"a": [draw.random() for _ in range(500)], "b": [draw.randrange(4) * 1.0 for _ in range(300)], "c": [5.0], "d": [-1.0, -1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None)]
    ps = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r.asDict() for r in nearest_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", ps, bins).collect()}
    for g, vs in groups.items():
        assert {n: got[g][n] for n in ps} == {n: sorted(vs)[max(1, math.ceil(round(p * len(vs), 9))) - 1] for n, p in ps.items()}


def test_linear_and_rounded_places(spark):
    draw = random.Random(9)
    groups = {None: [draw.random() for _ in range(101)], "b": [draw.randrange(5) * 1.0 for _ in range(40)], "c": [5.0], "d": [1.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("b", None)], "g string, v double")
    ps = {"low": 0.0, "p30": 0.3, "half": 0.5, "p95": 0.95, "top": 1.0}
    got, near = {r.g: r for r in linear(df, ["g"], "v", ps).collect()}, {r.g: r for r in rounded_ranks(df, ["g"], "v", ps).collect()}
    assert set(got) == set(near) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, p in ps.items():
            at = (len(vs) - 1) * p
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            assert abs(got[g][name] - (low + (high - low) * (at - math.floor(at)))) < 1e-12 and near[g][name] == vs[round(at)]


def test_run_reports(spark):
    rows = [("a", False, False, 1.0, 10.0), ("a", False, False, None, 20.0), ("a", True, False, 0.0, 99.0), ("a", False, True, 0.0, 99.0), ("b", True, False, 1.0, 5.0), (None, False, False, 0.5, 3.0)]
    df = spark.createDataFrame(rows, "g string, e boolean, s boolean, hit double, ms double")
    got = {r.g: r for r in run_reports.summarized(df, "g", F.col("e"), F.col("s"), ["hit"], ["ms"]).collect()}
    assert (got["a"].row_count, got["a"].evaluated, got["a"].skipped, got["a"].errors) == (4, 2, 1, 1)
    assert (got["a"].mean_hit, got["a"].mean_ms, got["a"].p50_ms, got["a"].p95_ms, got["a"].max_ms) == (1.0, 15.0, 15.0, 20.0, 20.0)
    assert (got["b"].evaluated, got["b"].mean_hit, got["b"].mean_ms, got["b"].p50_ms) == (0, None, 0.0, 0.0) and got[None].p95_ms == 3.0
    gains = {r.g: (r.n, r.gain) for r in run_reports.answer_gain(df, "g", "hit", "ms").collect()}
    assert gains == {"a": (3, round((9.0 + 99.0 + 99.0) / 3, 4)), "b": (1, 4.0), None: (1, 2.5)}
