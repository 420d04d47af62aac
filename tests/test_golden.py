"""Cases by hand of gold rows, answerability, row quality and claims."""

from pyspark.sql import functions as F

from corvane.operators import gold as G
from corvane.operators import golden, indexes, samples

WANT = "struct<file:string,docv:string,chunk:string,kind:string,sheet:string,tbl:string,cells:string,policy:string,physical:int,page:int,label:string,box:array<double>>"
GOT = "struct<file:string,docv:string,chunk:string,kind:string,sheet:string,tbl:string,cells:string,physical:int,page:int,label:string,box:array<double>,index:string,status:string>"


def want(file="f", kind="xlsx", sheet="s", tbl="", cells="A1:B2", policy="overlaps_expected", page=None, box=None):
    return (file, "", "", kind, sheet, tbl, cells, policy, None, page, "", box)


def got(file="f", kind="xlsx", sheet="s", tbl="t", cells="A1:B2", page=None, box=None, index="v", status="EMBEDDED"):
    return (file, None, None, kind, sheet, tbl, cells, None, page, None, box, index, status)


def run(spark, cases, **settings):
    gold = [(i, "b", x.get("hidden", ""), "secret", x.get("errors"), x.get("failed", False), x["want"]) for i, x in enumerate(cases)]
    hits = [(i, r, x.get("body", ""), h) for i, x in enumerate(cases) for r, h in enumerate(x["hits"], 1)]
    rows = golden.evaluated(spark.createDataFrame(gold, f"query_id int, bucket string, hidden_policy string, terms string, errors array<string>, failed boolean, want {WANT}"), spark.createDataFrame(hits, f"query_id int, rank int, body string, got {GOT}"), **settings)
    return rows, [(r.hit_rank, r.location_rank, r.outcome, r.reason) for r in rows.orderBy("query_id").collect()]


def test_scopes_hold_within_one_hit(spark):
    cases = [
        {"want": want(), "hits": [got(sheet="other"), got(file="g")]},  # the file in one hit, the sheet in another
        {"want": want(tbl="t"), "hits": [got(tbl="u"), got(sheet="other", tbl="t")]},
        {"want": want(tbl="t", cells="D9"), "hits": [got(), got(tbl="u", cells="D9")]},
        {"want": want(cells="D9"), "hits": [got(), got(sheet="other", cells="D9")]},
        {"want": want(), "hits": [got(cells="Z9"), got(cells="B2:C3")]},
        {"want": want(kind="pdf", page=3, box=[0.0, 0.0, 1.0, 1.0]), "hits": [got(kind="pdf", page=3, box=[5.0, 5.0, 6.0, 6.0]), got(kind="pdf", page=4, box=[0.0, 0.0, 1.0, 1.0])]},
        {"want": want(kind="pdf", page=3), "hits": [got(file="g", kind="pdf", page=3), got(kind="pdf", page=4)]},
        {"want": want(), "hits": []},
        {"want": want(), "hits": [got(status="pending")]},
        {"want": want(), "hits": [got()], "hidden": "negative", "body": "a SECRET"},
        {"want": want(), "hits": [got()], "hidden": "negative"},
        {"want": want(), "hits": [got()], "hidden": "exclude_hidden", "body": "a SECRET"},
        {"want": want(), "hits": [got()], "errors": ["unsupported bucket: b"]},
        {"want": want(), "hits": [], "failed": True},
    ]
    rows, found = run(spark, cases)
    assert found == [
        (1, None, "not_matched", "expected_sheet_not_found"), (1, None, "not_matched", "expected_table_not_found"), (1, None, "not_matched", "expected_range_not_found"), (1, None, "not_matched", "expected_range_not_found"),
        (1, 2, "matched", None), (1, None, "not_matched", "bbox_mismatch"), (2, None, "not_matched", "expected_page_not_found"), (None, None, "search_result_empty", "search_result_empty"),
        (None, None, "not_matched", "embedding_status_mismatch"), (None, None, "hidden_negative_failed", "hidden_content_returned"), (None, None, "hidden_negative_pass", None), (1, 1, "hidden_content_returned", "hidden_content_returned"),
        (None, None, "invalid_gold", "unsupported_bucket"), (None, None, "search_error", "unknown"),
    ]
    total = golden.metrics(rows).where("bucket is null").first()
    assert (total["count"], total.invalid, total.negative_pass, total.leaks, total.result_empty, total.filtered) == (11, 1, 1, 2, 1, 1)
    assert total.hit_at_1 == round(7 / 11, 4) and total.mrr_at_10 == round(7.5 / 11, 4) and total.citation_location_accuracy == round(2 / 11, 4)
    assert total.xlsx_table_hit == 0.5 and total.pdf_page_hit == 0.5 and total.pdf_bbox_overlap == 0.0


def test_index_versions_only_count_where_hits_have_one(spark):
    cases = [{"want": want(file="g"), "hits": [got(index="")]}, {"want": want(file="g"), "hits": [got(index="old")]}, {"want": want(file="g"), "hits": [got(index="old"), got(index="v")]}]
    assert [x[3] for x in run(spark, cases, candidate="v")[1]] == ["expected_file_not_found", "candidate_index_mismatch", "expected_file_not_found"]
    assert [x[3] for x in run(spark, cases, version="new")[1]] == ["required_index_version_mismatch"] * 3


def test_answerability_is_counted_by_query(spark):
    rows = [("v", 1, r, label, True, r == 1, ["wrong_page"] if r > 2 else []) for r, label in enumerate([3, 0, 0, 2], 1)]
    rows += [("v", 2, 1, 0, True, False, None), ("v", 2, 6, 3, True, False, ["wrong_page"]), ("v", 3, 1, 2, False, False, ["needs_subpage", "wrong_page"])]
    out = G.answerable(spark.createDataFrame(rows, "variant string, query_id int, rank int, label int, page_hit boolean, section_hit boolean, flags array<string>")).first()
    assert (out.queries, out.rows, out.page_only, out.off_section, out.wrong_page, out.needs_subpage) == (3, 7, 1, 1, 3, 1)
    assert (out.answerable_1, out.fully_5) == (round(2 / 3, 6), round(1 / 3, 6))


def test_quality_by_kind(spark):
    q, e = "가" * 30, "e" * 60
    rows = [(q, e, "plot_memory", 9, False), (q, e, "other", 9, False), (q, e, "other", 0, True), ("찾아줘", "", "ambiguous", 0, False)]
    df = spark.createDataFrame(rows, "q string, e string, k string, n int, c boolean")
    got_ = [r[0] for r in df.select(samples.row_quality(F.col("q"), F.col("e"), F.col("k"), F.col("n"), F.col("c"))).collect()]
    assert got_ == [124.0, 116.4, 96.0, 65.0]


def test_a_claim_visits_no_more_than_it_needs(spark):
    def units(n, blank, stale):
        rows = [(i, "PENDING", True, None, i, "blank" if i < blank else None) for i in range(n)]
        return spark.createDataFrame(rows + [(1000 + i, "EMBEDDING", True, 50 - i, 0, None) for i in range(stale)] + [(5000, "PENDING", False, None, 0, None)], "id long, status string, source_ready boolean, claimed_at long, at long, reason string")

    out = {(r.id, r.result) for r in indexes.claimed(units(30, 3, 5), 1000, 100, batch=10).collect()}
    assert out == {(i, "skipped") for i in range(3)} | {(i, "claimed") for i in range(3, 13)}
    out = {(r.id, r.result) for r in indexes.claimed(units(30, 25, 5), 1000, 100, batch=10).collect()}
    assert out == {(i, "skipped") for i in range(20)}  # twice the batch is looked at, and no stale claim as pending ones fill it
    out = {(r.id, r.result) for r in indexes.claimed(units(8, 4, 5), 1000, 100, batch=10).collect()}
    assert out == {(i, "skipped") for i in range(4)} | {(i, "claimed") for i in range(4, 8)} | {(1004, "claimed"), (1003, "claimed")}


def test_gate_names_each_reason(spark, tmp_path):
    from corvane.operators import gate
    from corvane.sources import resumable

    good = {name: 1.0 for name, _, kind, _ in gate.CHECKS if kind in ("min", "delta")} | {name: 0.0 for name, _, kind, _ in gate.CHECKS if kind in ("max", "exact")}
    texts = {"embedding_filtered_eval": "true", "required_embedding_status": "embedded"}
    rows = [("v1", k, v, None) for k, v in good.items()] + [("v1", k, None, t) for k, t in texts.items()] + [("v1", "required_index_version", None, "v1")]
    bad = good | {"parser_success_rate": 0.9, "unsupported_file_rate": 0.2, "fatal_warning_count": 2.0, "Hit@10": 0.5, "ocr_used_count": 3.0}
    del bad["MRR@10"]
    rows += [("v2", k, v, None) for k, v in (bad | {"mrr_at_10": 1.0}).items()] + [("v2", k, None, t) for k, t in texts.items()]
    kinds = "index_version string, name string, value double, text string"
    base = spark.createDataFrame([("hit_at_10", 0.8), ("MRR@10", 0.8)], "name string, value double")
    out = gate.decided(spark.createDataFrame(rows, kinds), base)
    assert {r.index_version: (r.decision, r.reasons) for r in out.collect()} == {
        "v1": ("PASSED", []),
        "v2": ("BLOCKED", [
            "parser_success_rate must be >= 0.95", "unsupported_file_rate must be <= 0.05", "OCR_confidence_avg is required when OCR-needed bucket is present", "Hit@10 must be >= baseline - 0.05 (0.750)",
            "fatal_warning_count must be 0", "required_index_version is required for promotion",
        ]),
    }
    snapshot = base.union(spark.createDataFrame([("_baseline_candidate_snapshot", 1.0)], "name string, value double"))
    assert gate.decided(spark.createDataFrame(rows, kinds), snapshot).where("index_version = 'v1'").first().reasons == ["baseline report must be an immutable baseline, not a candidate snapshot"]
    assert gate.decided(spark.createDataFrame(rows, kinds), base, parser_success_rate=0.5).where("index_version = 'v2'").first().reasons[0].startswith("unsupported")
    path = f"{tmp_path}/results"
    assert gate.persisted(out, path, "d") == 0 and gate.persisted(out, path, "d") == 2
    assert resumable.committed(spark, path, "index_version string, decision string").count() == 2
