import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import recovery
from corvane.sources import nested, resumable


def test_attempts_are_routed_and_judged(spark):
    docs = [(1, "red apple pie"), (2, "green apple tart"), (3, "blue sky"), (4, "red sky at night"), (5, "pie chart")]
    asked = [(10, "red pie", None, ["x"], "HYBRID_RECOVERY"), (11, "sky", "Sky Night", ["Pie chart"], "QUERY_REWRITE"), (12, "apple", None, [], "ANSWER"), (13, "tart", None, [], "HYBRID_RECOVERY"), (14, "nothing known", None, [], "HYBRID_RECOVERY")]
    frozen = [(10, 3, 1, 0.9), (10, 2, 2, 0.8), (11, 1, 1, 0.7), (12, 2, 1, 0.9), (14, 4, 1, 0.5)]
    gold = [(10, 1), (11, 4), (12, 2), (13, 2), (14, 4)]
    out = recovery.run(
        spark.createDataFrame(asked, "query_id long, query string, wanted string, titles array<string>, action string"), spark.createDataFrame(frozen, "query_id long, doc_id long, rank int, score double"),
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(gold, "query_id long, doc_id long"), final_k=2, hybrid_k=2,
    )
    got = {(r.query_id, r.mode): (r.plan, r.text, r.before, r.after, r.delta, r.skipped, r.recovered, r.regression) for r in out.collect()}
    assert got[12, None] == ("NOOP", None, 1, 1, None, True, False, False)
    assert got[13, None] == ("ATTEMPT_HYBRID", "tart", None, 1, -2, False, True, False)  # no first pass: the lexical list alone
    assert got[14, None][2:] == (1, 1, 0, False, False, False)  # nothing found: the first pass stays
    assert got[11, "oracle"][1] == "sky | Sky Night Pie chart" and got[11, "production_like"][1] == "sky | Pie chart"
    assert got[11, "oracle"][2:] == (None, 2, -1, False, True, False)
    assert got[10, None][3] == 2 and len(got) == 6


def test_resumed_after_a_failure(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(5, "again"), (None, "none")], "id long, t string")
    calls = []

    def make(some):
        calls.append(1)
        return some.withColumn("t", F.when(F.lit(len(calls) == 3), F.raise_error(F.lit("killed"))).otherwise(F.upper("t")).cast("string"))

    with pytest.raises(Exception, match="killed"):
        resumable.append(rows, path, "id", make, slices=5)
    first = resumable.committed(spark, path, "id long, t string").count()
    assert 0 < first < 100
    with open(f"{path}/torn.jsonl", "w") as f:
        f.write('# kept by hand\n{"id": 500, "t": "hand"}\n\n{"id": 7, "t": "to')
    assert resumable.append(rows, path, "id", make, slices=5) == first + 1
    got = sorted((r.id, r.t) for r in resumable.committed(spark, path, "id long, t string").collect())
    assert [i for i, _ in got] == [*range(100), 500] and all(t == f"T{i}" for i, t in got if i not in (5, 500))
    assert resumable.append(rows, path, "id", make) == 101
    assert resumable.mended(spark, path) == 1 and resumable.mended(spark, path) == 0
    assert resumable.drop(spark, path, "id", spark.createDataFrame([(3,), (500,)], "id long"), "long") == 2
    assert sorted(r.id for r in resumable.committed_once(spark, path, "id long, t string", "id").collect()) == [i for i in range(100) if i != 3]


def test_paths_of_all_shapes(spark):
    cases = {'"a > b"': "a > b", '["a","","b"]': "a > b", "null": "", "[]": "", "7": "7", '["a",1,true,null]': "a > 1 > True > None", "1.5": "1.5", "[[1]]": "[1]"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.p for r in df.select("v", nested.path_text(F.parse_json("v")).alias("p")).collect()} == cases


def test_elements_of_all_shapes(spark):
    cases = {'[{"a":1}]': [{"a": 1}], "[{'a': 1, 'b': None}]": [{"a": 1, "b": None}], "": [], "   ": [], "plain 'text": "plain 'text", "('a', 1)": "('a', 1)", '{"k":[1]}': {"k": [1]}, "5": 5}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "v string")
    got = {r.v: json.loads(r.j) for r in df.select("v", F.to_json(nested.elements(F.col("v"))).alias("j")).collect()}
    assert got == cases | {None: []}


def test_records_with_problems(spark):
    lines = ["", "# note", "{bad", "[1]", '{"docs":[]}', '{"query_id":1}', '{"query_id":"q","docs":{}}', '{"query_id":"e","docs":[]}',
             '{"query_id":"r","query":"x","docs":[1,{"chunk_id":"c"},{"rank":"z"},{"rank":"2","chunk_id":"c","title":"T","section_path":["a","b"]},{"rank":3,"chunk_id":"n","title":"U"},{"rank":4,"chunk_id":"c","title":"V"}]}']
    chunks = spark.createDataFrame([("c", "p", "T", "s", "a > b", "body")], "chunk_id string, page_id string, page_title string, section_id string, section_path string, chunk_text string")
    gold = spark.createDataFrame([("r", "g", "x")], "query_id string, page_id string, section_path string")
    got = sorted((r.query_id, r.rank or 0, r.problem or "", r.page_title or "", r.chunk_text or "", r.gold_page_id or "") for r in nested.adapted(spark.createDataFrame([(x,) for x in lines], "value string"), chunks, gold).collect())
    assert got == sorted([("", 0, "malformed", "", "", "")] * 2 + [("", 0, "no query_id", "", "", ""), ("1", 0, "no docs", "", "", ""), ("q", 0, "docs not a list", "", "", ""), ("r", 0, "result not an object", "", "", "g"), ("r", 0, "no rank", "T", "body", "g"), ("r", 0, "rank not a number", "", "", "g"), ("r", 2, "", "T", "body", "g"), ("r", 3, "missing chunk", "U", "", "g"), ("r", 4, "mismatch: page_title", "T", "body", "g")])
