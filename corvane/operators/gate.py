"""The promotion gate: an index version's metrics held against thresholds, all versions at once, with the reasons that block each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import resumable

#: Fixed: checks in order: what is shown, names it may have, kind (min, max, exact, delta to the baseline), limit.
CHECKS = (
    ("parser_success_rate", "", "min", 0.95),
    ("unsupported_file_rate", "", "max", 0.05),
    ("zero_indexable_chunk_count", "", "exact", 0.0),
    ("required_metadata_completeness", "", "min", 0.98),
    ("missing_required_metadata_count", "", "exact", 0.0),
    ("xlsx_citation_location_accuracy", "", "min", 0.90),
    ("pdf_citation_location_accuracy", "", "min", 0.85),
    ("table_detection_accuracy", "", "min", 0.80),
    ("OCR_confidence_avg", "ocr_confidence_avg", "ocr", 0.75),
    ("Hit@10", "hit_at_10", "delta", -0.05),
    ("MRR@10", "mrr_at_10", "delta", -0.05),
    ("citation_accuracy", "citation_location_accuracy", "min", 0.85),
    ("parsing_latency_p95", "parsing_latency_p95_seconds", "max", 30.0),
    ("indexing_latency_p95", "indexing_latency_p95_seconds", "max", 60.0),
    ("fatal_warning_count", "", "exact", 0.0),
    ("hidden_content_leakage_count", "", "exact", 0.0),
    ("embedding_filtered_eval", "", "filtered", 0.0),
    ("required_embedding_status", "", "status", 0.0),
    ("required_index_version", "", "version", 0.0),
    ("gate_input_missing_count", "", "exact", 0.0),
    ("indexing_filtered_hit_count", "", "exact", 0.0),
    ("candidate_index_mismatch_count", "", "exact", 0.0),
    ("required_index_version_mismatch_count", "", "exact", 0.0),
    ("embedding_status_mismatch_count", "", "exact", 0.0),
)
#: Fixed: counts any of which makes the confidence of recognition needed.
READ = ("OCR_needed_count", "ocr_needed_count", "ocr_needed_bucket_count", "ocr_bucket_count", "ocr_used_count", "pdf_ocr_noise_count", "pdf_ocr_noise_query_count")


def checks(spark: SparkSession, **limits: float) -> DataFrame:
    """place, name, other, kind, limit of all checks; limits by name take the place of the usual ones."""
    if unknown := set(limits) - {name for name, *_ in CHECKS}:
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    rows = [(i, name, other, kind, float(limits.get(name, limit))) for i, (name, other, kind, limit) in enumerate(CHECKS, 1)]
    return spark.createDataFrame(rows, "place int, name string, other string, kind string, limit double")


def _reason(name: Column, kind: Column, limit: Column, value: Column, text: Column, base: Column, version: Column, read: Column) -> Column:
    number = lambda form, x: F.format_string(form, x)
    least = base + limit
    sign = F.when(limit < 0, F.concat(F.lit("baseline - "), number("%.2f", F.abs(limit)))).when(limit > 0, F.concat(F.lit("baseline + "), number("%.2f", limit))).otherwise("baseline")
    missing = F.concat(name, F.lit(" is required"))
    low = F.when(value.isNull(), missing).when(value < limit, F.concat(name, F.lit(" must be >= "), number("%.2f", limit)))
    high = F.when(value.isNull(), missing).when(value > limit, F.concat(name, F.lit(" must be <= "), number("%.2f", limit)))
    exact = F.when(value.isNull(), missing).when(value.cast("long") != limit.cast("long"), F.concat(name, F.lit(" must be "), limit.cast("long").cast("string")))
    delta = F.when(value.isNull(), missing).when(base.isNull(), F.concat(F.lit("baseline "), missing)).when(value < least, F.concat(name, F.lit(" must be >= "), sign, F.lit(" ("), number("%.3f", least), F.lit(")")))
    seen = F.when(read & value.isNull(), F.lit("OCR_confidence_avg is required when OCR-needed bucket is present")).when(read, low)
    named = F.when(F.coalesce(text, F.lit("")) == "", F.lit("required_index_version is required for promotion")).when(text != version, F.lit("required_index_version must match promoted index_version"))
    filtered = F.when(F.coalesce(text, F.lit("")) != "true", F.lit("retrieval eval must require embedded SearchUnit results"))
    status = F.when(F.upper(F.coalesce(text, F.lit(""))) != "EMBEDDED", F.lit("required_embedding_status must be EMBEDDED"))
    return F.when(kind == "min", low).when(kind == "max", high).when(kind == "exact", exact).when(kind == "delta", delta).when(kind == "ocr", seen).when(kind == "version", named).when(kind == "filtered", filtered).when(kind == "status", status)


def decided(metrics: DataFrame, baseline: DataFrame, **limits: float) -> DataFrame:
    """index_version, decision (PASSED, BLOCKED), reasons in the checks' order, of metrics (index_version, name, value, text) against a baseline (name, value).

    A metric may go by either of its names, the first one first; text holds what is no number. A baseline with the metric _baseline_candidate_snapshot
    is none. Each version meets each check, of which there are as many as CHECKS has.
    """
    rules = F.broadcast(checks(metrics.sparkSession, **limits))
    versions = metrics.groupBy("index_version").agg(F.max((F.col("name").isin("OCR_confidence_avg", "ocr_confidence_avg") & F.col("value").isNotNull()) | (F.col("name").isin(*READ) & (F.col("value") > 0))).alias("read"))
    each = versions.withColumn("read", F.coalesce("read", F.lit(False))).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(CHECKS)))).alias("place")).join(rules, "place")
    own = metrics.groupBy("index_version", "name").agg(F.max("value").alias("value"), F.max("text").alias("text"))
    base = baseline.groupBy("name").agg(F.max("value").alias("value"))
    for alias, column in (("m", "name"), ("o", "other")):
        each = each.join(own.select("index_version", F.col("name").alias(column), F.col("value").alias(f"{alias}_value"), F.col("text").alias(f"{alias}_text")), ["index_version", column], "left")
        each = each.join(base.select(F.col("name").alias(column), F.col("value").alias(f"{alias}_base")), column, "left")
    two = lambda x: F.coalesce(f"m_{x}", f"o_{x}")
    reason = _reason(F.col("name"), F.col("kind"), F.col("limit"), two("value"), two("text"), two("base"), F.col("index_version"), F.col("read"))
    found = F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("place", reason.alias("reason")))))
    out = each.groupBy("index_version").agg(F.transform(found, lambda x: x.reason).alias("reasons"))
    snapshot = base.where("name = '_baseline_candidate_snapshot' and value <> 0").agg(F.count("*").alias("snapshot"))  # one row
    out = out.crossJoin(F.broadcast(snapshot))
    first = F.when(F.col("snapshot") > 0, F.array(F.lit("baseline report must be an immutable baseline, not a candidate snapshot"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("reasons", F.concat(first, F.col("reasons")))
    return out.select("index_version", F.when(F.size("reasons") > 0, "BLOCKED").otherwise("PASSED").alias("decision"), "reasons")


def persisted(results: DataFrame, path: str, dataset: str) -> int:
    """Appends decisions as JSON lines, one for each version and dataset, however often it is called; gives the number that was there."""
    key = F.sha2(F.concat_ws("|", F.lit(dataset), "index_version"), 256)
    return resumable.append(results.select(key.alias("id"), F.lit(dataset).alias("dataset_id"), "index_version", "decision", "reasons"), path, "id", slices=1)
