"""Queries that SQL can express agree with it on the smallest tables, and on tables made to have links and repeats."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from corvane.llm import registry, repeats, vectors

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    one = lambda x: "null" if x is None or (not isinstance(x, (list, np.ndarray)) and pd.isna(x)) else f"{x:.9g}" if isinstance(x, (float, np.floating)) else str(x)
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.execute(registry.ORACLE[name]).df())


def test_links_and_repeats_agree(spark, tmp_path):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((12, 16))
    vecs = [(i, (base[i % 12] + draw.standard_normal(16) * 0.06).astype(np.float32).tolist(), int(i % 2)) for i in range(120)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, base[0].tolist(), None)]
    said = [" ".join(f"w{draw.integers(40)}" for _ in range(30)) for _ in range(6)]
    docs = [(i, "\n".join(said[j] for j in draw.choice(6, 3)) + f" {i}é") for i in range(40)] + [(50, None), (51, ""), (3, said[0]), (None, said[1])]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for module in (vectors, repeats):
        got, want = module.query(spark, str(tmp_path)).toPandas(), con.execute(module.SQL).df()
        assert rows(got) == rows(want)
