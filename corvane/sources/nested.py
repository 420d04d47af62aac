"""Result records whose fields come in several shapes, read as variants: a path may be a text, a list or a number, and elements may be JSON or Python literals."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

JOINER = " > "


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text(value: Column) -> Column:
    """A scalar's text; nothing, and truth values, as the reference writes them."""
    kind = _kind(value)
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string"))).otherwise(F.try_variant_get(value, "$", "string"))


def path_text(value: Column) -> Column:
    """A variant path as one text: a text as it is, a list's parts that are not empty joined, nothing as the empty text. Parts that are lists stand as JSON."""
    parts = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), _text), lambda x: x != "")
    return F.when(_kind(value) == "VOID", "").when(_kind(value).startswith("ARRAY"), F.array_join(parts, JOINER)).otherwise(_text(value))


def words(value: Column) -> Column:
    """A field's text, empty where it is missing or false in the reference's sense."""
    out = F.coalesce(F.when(_kind(value) == "VOID", "").otherwise(_text(value)), F.lit(""))
    return F.when(out.isin("0", "False"), "").otherwise(out)


@F.pandas_udf(StringType())
def _literal(text: pd.Series) -> pd.Series:
    """JSON of a list or dict literal, else the text itself as JSON."""
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            found = ast.literal_eval(x)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            found = x
        return json.dumps(found if isinstance(found, (list, dict)) else x, default=str)

    return text.map(one)


def elements(text: Column) -> Column:
    """The variant of a text field: JSON, else a list or dict as Python writes it, else the text; nothing and blanks are an empty list."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    parsed = F.try_parse_json(bare)
    return F.when(bare == "", F.parse_json(F.lit("[]"))).when(parsed.isNotNull(), parsed).otherwise(F.try_parse_json(_literal(bare)))


def adapted(lines: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, query, rank, chunk_id, page_id, page_title, section_id, section_path, chunk_text, gold_page_id, gold_section_path, problem.

    lines: value, a JSON record with query_id, query and docs (rank, chunk_id, page_id, title, section_path); chunks: chunk_id, page_id, page_title, section_id,
    section_path, chunk_text, one row a chunk; gold: query_id, page_id, section_path. Blank lines and comments are skipped. A record or
    result that can't be read has a row with its `problem`, and so has one whose chunk is not known or says something else; what the chunk says then stands.
    """
    bare = F.trim("value")
    own = lines.where((bare != "") & ~bare.startswith("#")).withColumn("rec", F.try_parse_json("value"))
    at = lambda path: F.try_variant_get("rec", path, "variant")
    own = own.select(words(at("$.query_id")).alias("query_id"), words(at("$.query")).alias("query"), at("$.docs").alias("docs"), F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False)).alias("object"))
    problem = F.when(~F.col("object"), "malformed").when(F.col("query_id") == "", "no query_id").when(F.col("docs").isNull(), "no docs").when(~_kind(F.col("docs")).startswith("ARRAY"), "docs not a list")
    own = own.withColumn("problem", problem)
    bad = own.where("problem is not null").select("query_id", "query", "problem")
    each = own.where("problem is null").select("query_id", "query", F.explode(F.try_variant_get("docs", "$", "array<variant>")).alias("doc"))
    of = lambda name: F.try_variant_get("doc", f"$.{name}", "variant")
    each = each.select("query_id", "query", _kind(F.col("doc")).startswith("OBJECT").alias("object"), of("rank").alias("raw"), words(of("chunk_id")).alias("chunk_id"), words(of("page_id")).alias("page_id"), words(of("title")).alias("page_title"), path_text(of("section_path")).alias("section_path"))
    each = each.withColumn("rank", F.try_variant_get("raw", "$", "int"))
    each = each.withColumn("problem", F.when(~F.col("object"), "result not an object").when(_kind(F.col("raw")) == "VOID", "no rank").when(F.col("rank").isNull(), "rank not a number"))
    known = chunks.select("chunk_id", *[F.col(x).alias(f"c_{x}") for x in ("page_id", "page_title", "section_id", "section_path", "chunk_text")], F.lit(True).alias("known"))
    each = each.join(known, "chunk_id", "left")
    differs = F.array_compact(F.array(*[F.when((F.trim(x) != "") & (F.trim(f"c_{x}") != "") & (F.trim(x) != F.trim(f"c_{x}")), x) for x in ("page_id", "page_title", "section_path")]))
    said = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("known").isNull(), "missing chunk").when(F.size(differs) > 0, F.concat(F.lit("mismatch: "), F.array_join(differs, ",")))
    best = lambda x: F.coalesce(F.nullif(F.col(f"c_{x}"), F.lit("")), F.col(x)).alias(x)
    each = each.select("query_id", "query", "rank", "chunk_id", best("page_id"), best("page_title"), F.coalesce("c_section_id", F.lit("")).alias("section_id"), best("section_path"), F.coalesce("c_chunk_text", F.lit("")).alias("chunk_text"), said.alias("problem"))
    out = each.unionByName(bad, allowMissingColumns=True)
    return out.join(gold.select("query_id", F.col("page_id").alias("gold_page_id"), F.col("section_path").alias("gold_section_path")), "query_id", "left")
