from math import log2

from pyspark.sql import functions as F

from corvane.plans import evaluation, search


def test_graded_ndcg_of_more_than_100_000_labels(spark, tmp_path):
    """Every vector has a label of its own, so a query has two labels beside it and none of its own."""
    own = spark.range(300_000).select((F.col("id") * 20 + F.when(F.col("id") < 40, 0).otherwise(1)).alias("vec_id"), F.array(*[F.rand(i).cast("float") for i in range(64)]).alias("embedding"), (F.col("id") * 7919 % 300_000).cast("int").alias("label"))
    own.write.parquet(f"{tmp_path}/embeddings.parquet")
    dcg, labels = {}, {}
    for r in search.neighbours(spark, str(tmp_path)).collect():
        labels[r.query_id] = r.q_label
        dcg[r.query_id] = dcg.get(r.query_id, 0) + (abs(r.q_label - r.label) == 1) / log2(r["rank"] + 1)
    best = {q: 1 + (1 / log2(3) if 0 < x < 299_999 else 0) for q, x in labels.items()}
    got = {r.query_id: r.ndcg for r in evaluation.graded_ndcg(spark, str(tmp_path)).collect()}
    assert len(got) == 40 and got == {q: round(dcg[q] / best[q], 6) for q in dcg}
