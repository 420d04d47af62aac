"""Evaluation of gold rows, from ranked hits to metrics: each hit is held against what its row wants, then rows are judged and summed by bucket.

gold: query_id, bucket, hidden_policy, terms, errors (array of texts), failed (whether the search itself failed), want (a struct of file, docv, chunk, kind, sheet,
tbl, cells, policy, physical, page, label, box; empty and null wishes are met by anything). hits: query_id, rank, body (the serialised hit), got (a struct of
the same without policy, and index, status). One row a query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import gold as G
from corvane.operators.decisions import first_rule
from corvane.operators.verdicts import holds

#: Shares of rows in metrics: the row's flag, and the condition under which the row counts.
SHARES = {
    "citation_location_accuracy": ("located", "true"), "xlsx_citation_location_accuracy": ("located", "kind = 'xlsx'"), "pdf_citation_location_accuracy": ("located", "kind in ('pdf', 'ocr')"),
    "xlsx_file_hit": ("file", "kind = 'xlsx'"), "xlsx_sheet_hit": ("sheet", "kind = 'xlsx'"), "xlsx_table_hit": ("tbl", "kind = 'xlsx' and wants_table"),
    "xlsx_range_overlap": ("overlap", "kind = 'xlsx' and wants_range"), "xlsx_range_contains": ("contains", "kind = 'xlsx' and wants_range"), "xlsx_exact_range": ("exact", "kind = 'xlsx' and wants_range"),
    "pdf_file_hit": ("file", "kind in ('pdf', 'ocr')"), "pdf_page_hit": ("page", "kind in ('pdf', 'ocr') and wants_page"),
    "pdf_bbox_overlap": ("box", "kind in ('pdf', 'ocr') and wants_box"), "pdf_exact_bbox": ("exact_box", "kind in ('pdf', 'ocr') and wants_box"),
}


def _met(want: Column, got: Column) -> Column:
    """A wish that is empty, or the same."""
    return (F.coalesce(want, F.lit("")) == "") | holds(want == got)


def _hits(gold: DataFrame, hits: DataFrame, top_k: int, candidate: str, status: str, version: str) -> DataFrame:
    """For each query what any of its first hits met; what is found of a sheet, table, range, page or box is looked for in hits that met what stands above it only."""
    want, got = F.col("want"), F.col("got")
    sheets, pages = holds(want.kind == "xlsx"), holds(want.kind.isin("pdf", "ocr"))
    file = _met(want.file, got.file)
    status_ok = F.lit(True) if not status else holds(F.upper(F.coalesce(got.status, F.lit(""))) == status.upper())
    version_ok = F.lit(True) if not version else holds(got["index"] == version)
    identity = file & _met(want.docv, got.docv) & _met(want.chunk, got.chunk) & _met(want.kind, got.kind) & status_ok & version_ok
    sheet = file & sheets & _met(want.sheet, got.sheet)
    tbl = sheet & _met(want.tbl, got.tbl)
    scope = F.when(F.coalesce(want.tbl, F.lit("")) != "", tbl).otherwise(sheet)
    given = (F.coalesce(want.cells, F.lit("")) != "") & (F.coalesce(got.cells, F.lit("")) != "")
    ranged = lambda policy: scope & given & G.range_met(want.cells, got.cells, F.lit(policy))
    number = lambda c: want[c].isNull() | holds(want[c] == got[c])
    page = file & pages & number("physical") & number("page") & _met(want.label, got.label)
    box = page & want.box.isNotNull()
    indexed = F.coalesce(got["index"], F.lit("")) != ""
    flags = {
        "version": version_ok, "status": status_ok, "file": file, "sheet": sheet, "tbl": tbl, "cells": scope & G.range_met(want.cells, got.cells, F.coalesce(F.nullif(want.policy, F.lit("")), F.lit("none"))),
        "overlap": ranged("overlaps_expected"), "contains": ranged("contains_expected"), "exact": ranged("exact_match"), "page": page, "box": box & G.boxes_overlap(want.box, got.box), "exact_box": box & G.boxes_equal(want.box, got.box),
        "indexed": indexed, "candidate": indexed & holds(got["index"] == candidate), "leak": holds(G.leaks(F.col("hidden_policy"), F.col("terms"), F.col("body"))),
    }
    rows = hits.where(F.col("rank") <= top_k).join(gold.select("query_id", "hidden_policy", "terms", "want"), "query_id")
    any_ = [F.max(holds(c).cast("int")).cast("boolean").alias(k) for k, c in flags.items()]
    ranks = [F.min(F.when(identity, F.col("rank"))).alias("hit_rank"), F.min(F.when(identity & holds(G.location_met(want, got)), F.col("rank"))).alias("location_rank")]
    return rows.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(~(status_ok & version_ok)).alias("filtered"), *ranks, *any_)


def evaluated(gold: DataFrame, hits: DataFrame, top_k: int = 10, candidate: str = "", status: str = "EMBEDDED", version: str = "") -> DataFrame:
    """Each gold row with hit_rank, location_rank, located, leak, outcome, reason, and the flags and conditions of SHARES."""
    want = F.col("want")
    seen = _hits(gold, hits, top_k, candidate, status, version)
    flags = [c for c, kind in seen.dtypes if kind == "boolean"]
    out = gold.join(seen, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(c, F.lit(0)) for c in ("hits", "filtered")})
    said = lambda c: F.coalesce(want[c].cast("string"), F.lit("")) != ""
    index = F.lit(True) if not candidate else ~F.col("indexed") | F.col("candidate")
    state = F.struct("hits", index.alias("index"), *[F.col(c) for c in ("version", "status", "file", "sheet", "tbl", "cells", "page", "box")])
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    policy = F.exists(errors, lambda x: x.contains("range_match_policy") | x.contains("A1-style") | x.contains("bbox"))
    invalid = F.when(F.exists(errors, lambda x: x.contains("unsupported bucket")), "unsupported_bucket").when(policy, "match_policy_error").otherwise("gold_label_invalid")
    bad, negative, failed, leak, located = F.size(errors) > 0, holds(F.col("hidden_policy") == "negative"), F.coalesce("failed", F.lit(False)), F.col("leak"), F.col("location_rank").isNotNull()
    reason = G.failure_reason(want, state)
    verdict = lambda outcome, why: F.struct(F.lit(outcome).cast("string").alias("outcome"), (why if isinstance(why, Column) else F.lit(why)).cast("string").alias("reason"))
    judged = first_rule([
        (bad, verdict("invalid_gold", invalid)),
        (negative & failed, verdict("search_error", "unknown")),
        (negative & leak, verdict("hidden_negative_failed", "hidden_content_returned")),
        (negative, verdict("hidden_negative_pass", None)),
        (leak, verdict("hidden_content_returned", "hidden_content_returned")),
        (failed, verdict("search_error", "unknown")),
        (located, verdict("matched", None)),
        (reason == "search_result_empty", verdict("search_result_empty", reason)),
    ], None)
    judged = F.coalesce(judged, verdict("not_matched", reason))
    out = out.withColumns({"judged": judged, "ranked": ~bad & ~negative, "located": located & ~bad & ~negative, "kind": want.kind, "wants_table": said("tbl"), "wants_range": said("cells"), "wants_page": said("physical") | said("page") | said("label"), "wants_box": want.box.isNotNull()})
    hidden = bad | negative
    out = out.withColumns({c: F.when(~hidden, F.col(c)) for c in ("hit_rank", "location_rank")})
    return out.select("*", "judged.outcome", "judged.reason").drop("judged")


def metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """bucket (null for all rows), count, hit_at_k, mrr_at_10, SHARES, and counts of outcomes, of `evaluated` rows; rows that are invalid or negative
    count among outcomes only. A share of no rows is 0 for all, as of a bucket."""
    live = F.col("ranked")
    share = lambda flag, when: F.round(F.coalesce(F.avg(F.when(live & F.expr(when), F.col(flag).cast("int"))), F.lit(0.0)), 4)
    early = lambda k: F.coalesce(F.col("hit_rank") <= k, F.lit(False))
    out = [F.count_if(live).alias("count")]
    out += [F.round(F.coalesce(F.avg(F.when(live, early(k).cast("int"))), F.lit(0.0)), 4).alias(f"hit_at_{k}") for k in ks]
    out += [F.round(F.coalesce(F.avg(F.when(live, F.when(early(10), 1.0 / F.col("hit_rank")).otherwise(0.0))), F.lit(0.0)), 4).alias("mrr_at_10")]
    out += [share(flag, when).alias(name) for name, (flag, when) in SHARES.items()]
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    out += [F.count_if((F.col("hits") == 0) & (F.col("outcome") != "invalid_gold") & ~F.coalesce("failed", F.lit(False))).alias("result_empty"), is_("invalid_gold").alias("invalid"), F.count_if(F.col("leak") & (F.col("outcome") != "invalid_gold")).alias("leaks"), is_("hidden_negative_pass").alias("negative_pass"), F.sum(F.when(F.col("outcome") != "invalid_gold", F.col("filtered")).otherwise(0)).alias("filtered")]
    return rows.rollup("bucket").agg(*out)


def reasons(rows: DataFrame) -> DataFrame:
    """bucket (null for all rows), reason, n of failed rows."""
    bad = rows.where("reason is not null").select("bucket", "reason")
    return bad.groupingSets([["bucket", "reason"], ["reason"]], "bucket", "reason").agg(F.count("*").alias("n"))
