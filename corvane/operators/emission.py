"""Export of chunks: sections cut within a budget of tokens, written as JSON lines that a stopped run resumes, with provenance, digests and a summary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import units as U
from corvane.operators.chunking import Budget, section_pieces, token_chunks
from corvane.sources import resumable

CHUNKS = "doc_id long, section string, chunk int, text string, chars int, tokens int, boundary string, cut boolean"


def section_token_chunks(sections: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """CHUNKS rows of rows (doc_id, section, chunks, list (name, desc), text): a section's units, parted as paragraphs, within a budget of tokens; chunk counts
    within the section. A section without units has none."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, s, chunks, entries, text in frame.itertuples(index=False):
                entries = [] if entries is None else [(x["name"], x["desc"]) for x in entries]
                found = section_pieces([] if chunks is None else list(chunks), entries) or ([text] if (text or "").strip() else [])
                rows += [(d, s, i, x[0], len(x[0]), *x[1:]) for i, x in enumerate(token_chunks("\n\n".join(found), budget))]
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in CHUNKS.split(", ")])

    return sections.select("doc_id", "section", "chunks", "list", "text").mapInPandas(run, CHUNKS)


def cache_key(corpus: str, changed: int, model: str, most: int, variant: str) -> str:
    """16 digits that tell apart indexes of a corpus (and when it changed), a model, its longest input and a text variant."""
    return hashlib.sha256(f"{corpus}|{changed}|{model}|{most}|{variant}".encode()).hexdigest()[:16]


def records(chunks: DataFrame, titles: DataFrame, variant: str) -> DataFrame:
    """doc_id, chunk_id, section, chunk, text, tokens, boundary, cut, embedding_text, digest of CHUNKS rows and titles (doc_id, title, retrieval_title, kind)."""
    own = chunks.join(titles, "doc_id", "left")
    text = U.production_text(variant, F.col("title"), F.col("retrieval_title"), F.array("section"), F.col("kind"), F.col("text"))
    name = F.concat(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "section", F.col("chunk").cast("string"), "text").cast("binary")), 1, 24), F.lit("_"), F.col("chunk").cast("string"))
    own = own.withColumn("embedding_text", text)
    return own.select("doc_id", name.alias("chunk_id"), "section", "chunk", "text", "tokens", "boundary", "cut", "embedding_text", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("digest"))


def emitted(sections: DataFrame, titles: DataFrame, path: str, variant: str, budget: Budget = Budget(), slices: int = 8, upto: int | None = None) -> int:
    """Writes the chunks of documents that the folder has none of, document by document in slices; gives how many documents it had. A document without
    chunks is tried again by each run, which writes nothing for it."""
    docs = sections.select("doc_id").distinct()

    def make(some: DataFrame) -> DataFrame:
        return records(section_token_chunks(sections.join(some, "doc_id", "left_semi"), budget), titles.join(some, "doc_id", "left_semi"), variant)

    return resumable.append(docs, path, "doc_id", make, slices, upto)


def corpus_digest(rows: DataFrame, digest: str = "digest") -> Column:
    """An aggregate that tells corpora of other digests apart, in whatever order tasks add them up: the sum of their heads."""
    return F.sum(F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)"))


def summary(spark: SparkSession, path: str, budget: Budget = Budget()) -> DataFrame:
    """One row: documents, sections, chunks, those cut within a word or sentence and those over the hard limit, and the digest of all; with chunks by boundary as a map."""
    rows = resumable.committed(spark, path, "doc_id long, section string, chunk int, tokens int, boundary string, cut boolean, digest string")
    limits = asdict(budget)
    hard = F.lit(limits.get("hard", 1 << 30))
    by = rows.groupBy("boundary").agg(F.count("*").alias("n"), F.count_if("cut").alias("cut"), F.count_if(F.col("tokens") > hard).alias("over"), corpus_digest(rows).alias("digest"))
    kinds = by.agg(F.sum("n").alias("chunks"), F.sum("cut").alias("cut"), F.sum("over").alias("over"), F.sum("digest").cast("string").alias("digest"), F.map_from_entries(F.collect_list(F.struct("boundary", "n"))).alias("by_boundary"))
    places = rows.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("doc_id", "section").alias("sections"))
    return places.crossJoin(kinds)  # one row each
