"""Deterministic embeddings by hashed tokens, for runs without a model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def hashed(tokens: list[str], dims: int) -> list[float]:
    """Signed counts of tokens by a keyed digest, scaled to length one; all zeros without tokens."""
    out = np.zeros(dims)
    for token in tokens:
        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out[int.from_bytes(digest[:4], "little") % dims] += 1.0 if digest[4] & 1 else -1.0
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).tolist()


def embedded(docs: DataFrame, dims: int = 64) -> DataFrame:
    """doc_id, vector of each text's tokens."""
    @F.pandas_udf("array<double>")
    def embed(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda x: hashed(list(x), dims))

    return docs.select("doc_id", embed(T.tokens(F.col("text"))).alias("vector"))
