"""Quality rules with host verdicts: rule failures by host, rates shrunk with an empirical beta prior, verdicts joined back.

A document fails a rule on its own counts. A host's failure rate is drawn to what hosts have in common: the beta prior whose
mean and variance are those of the hosts' rates (method of moments, weighted by documents), so that a host of few documents is
judged by its peers and a large one by itself. A host is rejected where its shrunk rate of failed documents exceeds
`reject_over`; its documents are then not kept, whatever their own counts. The host of `documents` is its column source.

Counts by host are summed before they are shuffled; documents meet their host's verdict by a join whose other side has one row
for each host and salt, so that a host of any share of the rows is spread over tasks.

Defined results: a null or blank text has no words and fails. A null host is a host. Repeated rows are documents of their own.
Without documents there are no hosts and no rows. Further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.common import SPACE

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, REJECT_OVER, SALTS = 50, 50, 0.5, 32
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    inner = np.frombuffer(b"".join(words), dtype=np.uint8)
    chars = int(np.count_nonzero((inner & 0xC0) != 0x80))
    symbols = len(text.translate(None, NOT_SYMBOLS))
    lines = text.split(b"\n")
    repeated = 0
    if len(lines) > 1:
        full = [x for x in lines if x.strip(SPACE)]
        repeated = len(full) - len(set(full))
    return len(words), chars, symbols, repeated, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, n)
    m = len(known)
    if m < 2_000_000:
        windows = (at[:-2] * m + at[1:-1]) * m + at[2:]
    else:
        first = np.unique(at[:-1] * m + at[1:], return_inverse=True)[1]
        windows = first[:-1] * m + at[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def rules(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """doc_id, host, the five counts and base_failed of every document."""
    def step(batch: dict) -> dict:
        found = np.array([counts(x.as_py()) for x in batch["text"]], dtype=np.int64)
        return {"doc_id": batch["doc_id"], "host": batch["host"], **dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), found.T, strict=True))}

    own = common.pick(docs, "doc_id", "text", host).select(F.col("doc_id").cast("long"), common.as_bytes(F.col("text")).alias("text"), F.col(host).cast("string").alias("host"))
    out = common.per_batch(own, step, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))


def hosts(ruled: DataFrame, reject_over: float = REJECT_OVER) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected. The prior comes from one row of sums over hosts."""
    own = ruled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    share = F.col("failed") / F.col("n")
    # Moments with documents as weights, all as sums: total n, failed, sum of n * rate^2, and hosts.
    sums = own.agg(F.sum("n").cast("double").alias("total"), F.sum("failed").cast("double").alias("all_failed"), F.sum(F.col("failed") * share).alias("squares"), F.count("*").cast("double").alias("k"))
    mean = F.col("all_failed") / F.col("total")
    spread = F.greatest(F.col("squares") / F.col("total") - mean * mean, F.lit(0.0))
    within = mean * (1 - mean) * F.col("k") / F.col("total")
    between = F.greatest(spread - within, F.lit(1e-6))
    strength = F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(2.0)), F.lit(1000.0))
    prior = sums.select((mean * strength).alias("a"), ((1 - mean) * strength).alias("b"))
    out = own.crossJoin(F.broadcast(prior))  # one row
    rate = (F.col("failed") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))
    return out.select("host", "n", "failed", rate.alias("rate"), (rate > reject_over).alias("rejected"))


def judged(ruled: DataFrame, reject_over: float = REJECT_OVER) -> DataFrame:
    """The ruled documents with their host's shrunk rate and `kept`. `ruled` is read twice."""
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    key = lambda c: F.coalesce(F.concat(F.lit("h"), F.col(c)), F.lit("n"))
    verdicts = hosts(ruled, reject_over).select(key("host").alias("_key"), "rate", "rejected", each)
    own = ruled.withColumn("_key", key("host")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    return own.join(verdicts, ["_key", "_salt"]).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("_key", "_salt", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = common.cut(rules(common.table(spark, sf_dir, "documents")))
    return judged(ruled).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rate").alias("host_rate"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM p),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n >= 2),
v AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM m, (VALUES (0), (1), (2)) o(k) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN v USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::BIGINT AS failed FROM b GROUP BY source),
s AS (SELECT sum(n)::DOUBLE AS total, sum(failed)::DOUBLE AS bad, sum(failed * (failed / n)) AS squares, count(*)::DOUBLE AS k FROM h),
q AS (SELECT bad / total AS mean, least(greatest((bad / total) * (1 - bad / total) / greatest(greatest(squares / total - (bad / total) * (bad / total), 0) - (bad / total) * (1 - bad / total) * k / total, 1e-6) - 1, 2), 1000) AS strength FROM s),
j AS (SELECT source, (failed + mean * strength) / (n + mean * strength + (1 - mean) * strength) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.5 AS kept, rate AS host_rate
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source
"""
