"""Wiki pages and sheets by hand."""

from pyspark.sql import functions as F

from corvane.functions import wiki as W
from corvane.operators import sheets as S


def test_block_before_a_page(spark):
    notes = "제목 최근 수정 시각: 2024-01-02 03:04:05 12 편집 토론 역사 편집 권한이 부족합니다. [펼치기 · 접기] · "
    texts = [notes + "본문 [편집] 이다.  끝" + " 말" * 60, "본문만 있다", None, "", notes + "x", "x" * 3100 + notes + "본문"]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", W.prepared(F.col("t")).alias("p")).orderBy("i").collect()]
    assert (got[0].text, got[0].marks, got[0].dropped) == ("본문 이다. 끝" + " 말" * 60, 1, False) and got[0].cut == len(notes.rstrip())
    assert got[1].text == "본문만 있다" and got[1].cut == 0 and got[3].text == ""
    assert got[4].dropped and got[4].text == "" and got[5].cut == 0


def test_aliases_and_terms(spark):
    rows = [(["Star"], ["별"]), (["별"], ["Star"]), (["Star"], ["Star 별"]), ([], ["x"]), (None, None)]
    got = spark.createDataFrame(rows, "w array<string>, t array<string>").select(W.looks_like_alias(F.col("w"), F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == [True, True, False, False, False]
    assert spark.range(1).select(W.translated(F.lit("hit rate and hit"), {"hit": "x", "hit rate": "y"})).first()[0] == "y and x"


def test_shown_values(spark):
    rows = [(0.125, "0%"), (0.125, "0.0%"), (1234.5, "#,##0.00"), (2.0, "General"), (2.5, "General"), (None, "0"), (1234.567, "0.00")]
    got = spark.createDataFrame(rows, "v double, f string").select(W.shown(F.col("v"), F.col("f")).alias("s")).collect()
    assert [r.s for r in got] == ["12%", "12.5%", "1,234.50", "2", "2.5", "", "1234.57"]


CELLS = "book string, sheet string, row int, col int, value string, hidden boolean"


def sheet(name, rows, hidden=()):
    return [("b", name, r, c, v, (r, c) in hidden) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]


def test_rows_keep_hidden_places(spark):
    rows = S.rows_of(spark.createDataFrame(sheet("s", [["a", "b", "c"], ["", "", ""], ["pen", "x", "7", ""]], {(3, 2)}) + [("b", "s", 9, 1, "gone", True)], CELLS))
    assert [(r.place, r.row, r["values"]) for r in rows.orderBy("place").collect()] == [(1, 1, ["a", "b", "c"]), (2, 3, ["pen", "", "7"])]
    own = spark.createDataFrame(sheet("s", [[str(i)] for i in range(5)]), CELLS)
    cut = S.rows_of(own, most=3)
    assert [(r.row, r.more) for r in cut.orderBy("row").collect()] == [(1, True), (2, True), (3, True)]
    assert [(r.row, r.cut) for r in S.exported(own, S.rows_of(own), most=4).orderBy("row").collect()] == [(i, True) for i in (1, 2, 3, 4)]


def test_headers_name_the_values(spark):
    title = [["Report"], ["name", "", "name"]] + [[f"n{i}", str(i), "" if i % 2 else "z"] for i in range(60)]
    small = sheet("t", [["k", "v"], ["1", "2"]])
    rows = S.rows_of(spark.createDataFrame(sheet("s", title) + small, CELLS))
    got = {(r.sheet, r.part, r.cells): r.text for r in S.row_groups(rows).collect()}
    # The headers' own row has a blank and a repeat, so that it is not found again and the first row counts as theirs.
    assert sorted(got) == [("s", 0, "A2:C51"), ("s", 1, "A52:C62")]
    assert got["s", 1, "A52:C62"].split("\n")[:4] == ["[Sheet: s]", "[Range: A52:C62]", "name: n49 | B: 49", "name: n50 | B: 50 | name_2: z"]
    assert got["s", 0, "A2:C51"].split("\n")[2:4] == ["name: name | name_2: name", "name: n0 | B: 0 | name_2: z"]
    plain = [["name", "age"]] + [[f"n{i}", str(i), "extra"] for i in range(51)]
    got = S.row_groups(S.rows_of(spark.createDataFrame(sheet("p", plain), CELLS))).orderBy("part").collect()
    assert [(r.part, r.cells) for r in got] == [(0, "A2:C51"), (1, "A52:C52")] and got[1].text == "[Sheet: p]\n[Range: A52:C52]\nname: n50 | age: 50 | C: extra"
    assert spark.range(1).select(S.letters(F.lit(1)), S.letters(F.lit(26)), S.letters(F.lit(27)), S.letters(F.lit(80))).first()[:] == ("A", "Z", "AA", "CB")


def test_tables_of_ranges_and_of_small_sheets(spark):
    rows = S.rows_of(spark.createDataFrame(sheet("s", [["k", "v"], ["a|b", "1"], ["c", "2"], ["", "x", "y"], ["", "z", "w"]]) + sheet("t", [["k", "v"], ["1", "2"]]) + sheet("u", [["one"], ["two"]]), CELLS))
    ranges = [("b", "s", 0, "T", 1, 3, 1, 2), ("b", "s", 1, "U", 4, 5, 2, 3), ("b", "s", 2, "E", 50, 60, 1, 1)]
    out = {(r.sheet, r.table_id): r for r in S.tables(rows, spark.createDataFrame(ranges, "book string, sheet string, at int, table_id string, r0 int, r1 int, c0 int, c1 int")).collect()}
    assert set(out) == {("s", "T"), ("s", "U"), ("s", "E"), ("t", "DetectedTable1")}
    assert out["s", "T"].table == "| k | v |\n| --- | --- |\n| a\\|b | 1 |\n| c | 2 |" and out["s", "T"].text == "[Sheet: s]\n[Range: A1:B3]\nk: a|b | v: 1\nk: c | v: 2"
    assert (out["s", "T"].header_cells, out["s", "T"].data_cells) == ("A1:B1", "A2:B3")
    assert out["s", "U"].headers == ["x", "y"] and out["s", "U"].text.endswith("x: z | y: w") and out["s", "U"].cells == "B4:C5"
    assert out["s", "E"].headers == ["k", "v"] and out["s", "E"].table == "" and out["s", "E"].text == "[Sheet: s]\n[Range: A50:A60]"
    assert out["t", "DetectedTable1"].kind == "detected" and out["t", "DetectedTable1"].cells == "A1:B2"


def test_cells_meet_the_last_range(spark):
    cells = spark.createDataFrame([("b", "s", r, c) for r in (1, 64, 65, 200) for c in (1, 2)], "book string, sheet string, row int, col int")
    ranges = spark.createDataFrame([("b", "s", 0, "A1:B64", 1, 64, 1, 2), ("b", "s", 1, "B60:B300", 60, 300, 2, 2)], "book string, sheet string, at int, name string, r0 int, r1 int, c0 int, c1 int")
    got = {(r.row, r.col): r.merged for r in S.in_ranges(cells, ranges, "name", "merged").collect()}
    assert got == {(1, 1): "A1:B64", (1, 2): "A1:B64", (64, 1): "A1:B64", (64, 2): "B60:B300", (65, 1): None, (65, 2): "B60:B300", (200, 1): None, (200, 2): "B60:B300"}
