"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Null ids, null and empty texts, repeated rows and empty tables pass through the stages as their operators define. All stages but
the last return the columns of documents; n_chars is counted anew where a stage changes the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, common, line_dedup, mixing, near_copies, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents that (left_semi) or that don't (left_anti) stand in rows (doc_id, digest), of which no more than a bounded number is broadcast."""
    own = docs.withColumn("_digest", common.digest_of(F.col("text")))
    rows = common.bounded(rows.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of")))
    return own.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is at or over a half go; of rows with one id each goes by its own text."""
    own = common.pick(docs, *COLUMNS)
    scores = toxicity.scored(own, common.table(spark, sf_dir, "labels"))
    return _with(own, scores.where("predicted = 1"), "left_anti").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; a document of nothing else stays, with an empty text."""
    common.give_back()  # what the driver has freed since the classifier was fitted
    own = common.pick(docs, *COLUMNS)
    kept = line_dedup.LineIndex(spark, min_docs=10).insert(own).apply(own, keep=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id; of repeated rows one. Pairs whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more join a group."""
    common.give_back()
    own = common.pick(docs, *COLUMNS)
    kept = common.cut(near_copies.representatives(own))
    once, more = (_with(own, kept.where(x), "left_semi") for x in ("copies = 1", "copies > 1"))
    return once.unionByName(more.dropDuplicates(["doc_id", "_digest"])).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of whole documents in training order, each source's words near its target."""
    return mixing.training_copies(mixing.assign(common.pick(docs, *COLUMNS), keep=COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each copy, in whole, and the text that they decode to."""
    return bpe.coded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: SQL has no form of the toxicity scores, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, without the decoded text that it has written."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs.select("doc_id", "n_tokens", "ids")
