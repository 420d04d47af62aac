"""Ties of the tables' values, which small tables hardly have, come out as the SQL has them."""

import datetime

import duckdb

from corvane import catalog
from test_queries import rows


def test_gold_evaluation_of_equal_prices(spark, tmp_path):
    day = datetime.datetime(1998, 3, 4)
    orders = [(q, q, "FOP"[q % 3], 1000.0 * q, day, f"{3 + q % 3}-X") for q in range(60)]
    lines = [(q, (i * 7 + q) % 5, i, i, [100.0, 100.0, None, 90.0][(i + q) % 4], 0.03, "ANR"[(i + q) % 3] if i + q else None, "OF"[(i * q) % 2], day) for q in range(60) for i in range(8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = rows(con.execute(catalog.ORACLE["gold_evaluation"]).df())
    assert rows(catalog.QUERIES["gold_evaluation"](spark, str(tmp_path)).toPandas()) == want
