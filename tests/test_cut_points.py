"""Quantiles whatever the sketch gives, and of groups without values."""

import random

import duckdb
from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import quantiles
from test_queries import rows


def test_a_sketch_that_differs_each_time(spark, monkeypatch):
    def unstable(column, ps, _):
        draw = F.udf(lambda n: sorted(random.SystemRandom().uniform(0, n) for _ in ps), "array<double>").asNondeterministic()
        return draw(F.max(column))

    monkeypatch.setattr(quantiles.F, "percentile_approx", unstable)
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).cast("double").alias("v"))
    for _ in range(3):
        got = {r.g: (r.p50, r.p95) for r in quantiles.nearest_ranks(df, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
        assert got == {0: (999.0, 1899.0), 1: (999.0, 1899.0)}


def test_length_distribution_of_no_lang_and_no_text(spark, tmp_path):
    docs = [(i, "x" * (i * 37 % 3000), ["en", None][i % 2]) for i in range(50)] + [(50, None, "de"), (51, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(catalog.QUERIES["length_distribution"](spark, str(tmp_path)).toPandas()) == rows(con.execute(catalog.ORACLE["length_distribution"]).df())
