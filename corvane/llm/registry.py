"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from corvane.llm import alignment, bpe, debruijn, fim, html_text, line_dedup, mixing, quality, repeats, simhash, toxicity, vectors, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_html_text": html_text.query,
    "op2_line_dedup": line_dedup.query,
    "op3_simhash": simhash.query,
    "op4_warc": warc.query,
    "op5_mixing": mixing.query,
    "op6_repeats": repeats.query,
    "op7_quality": quality.query,
    "op8_toxicity": toxicity.query,
    "op9_vectors": vectors.query,
    "op10_bpe": bpe.query,
    "op11_debruijn": debruijn.query,
    "op12_fim": fim.query,
    "op13_alignment": alignment.query,
}
ORACLE = {
    "op2_line_dedup": line_dedup.SQL,
    "op4_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
    "op6_repeats": repeats.SQL,
    "op7_quality": quality.SQL,
    "op9_vectors": vectors.SQL,
    "op11_debruijn": debruijn.SQL,
    "op12_fim": fim.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
