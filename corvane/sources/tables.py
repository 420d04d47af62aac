"""Named tables under a folder, in any of the formats the engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a file or folder by its suffix: .jsonl, .json (one array or object), .csv, .tsv, .orc or .parquet."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind in ("csv", "tsv"):
        out = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
        return out.toDF(*[c.lstrip("﻿") for c in out.columns])
    return reader.orc(path) if kind == "orc" else reader.parquet(path)


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an ingest: blank and malformed lines are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an evaluation set: blank lines and lines that begin with # are skipped, a malformed line fails the read and is named."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where(F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))).otherwise(F.lit(True)).cast("boolean"))
    return good.select("r.*").drop("_bad")


def write_csv_report(rows: DataFrame, path: str) -> None:
    """Columns in order of name, arrays joined by a bar, nulls empty."""
    columns = [F.coalesce(F.array_join(c, "|") if kind.startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in sorted(rows.dtypes)]
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """The summary's one row and the report's rows, as JSON lines in two folders; rows are never gathered into one document."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` with the rows of `changes` in place of those with the same keys."""
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
