"""Reversible line deduplication: exact reference counts of line keys, with sharded cuckoo filters of the frequent ones.

The state is two tables in the shared folder. `counts` has one row per line key: in how many documents it occurs.
`filters` has one cuckoo filter per shard, of the keys whose count is at or over the threshold. Inserting or deleting
documents merges their counts and moves only those keys in the filters that crossed the threshold, either way; a shard that
outgrows its filter, or the state its number of shards, is built anew from the counts.

Applying the state passes most lines by where they stand, as the filters tell, and confirms the rest by the exact keys. Up to
`broadcast_keys` frequent keys (16 bytes each) and their filters go to all tasks, which then handle whole documents without a shuffle.
Beyond that number the lines are sent to their shards, and the hits are joined with the exact keys and with their documents.

Defined results: a null text is an empty one, an empty text is one empty line, and an empty line is always kept. Every row
is a document, repeated rows too. Rows with a null doc_id are documents like others. Further columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.common import SPACE
from corvane.llm.cuckoo import Cuckoo

SHARDS, SHARD_KEYS, BROADCAST_KEYS = 64, 50_000, 500_000
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(UPPER)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def shard_of(column: str, shards: int) -> F.Column:
    """The shard of a key: its bytes 8 to 11 as a number, modulo the number of shards."""
    return F.pmod(F.conv(F.hex(F.substring(column, 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)[:, 8:12]
    return np.ascontiguousarray(raw).view(">u4").ravel().astype(np.int64) % shards


def _documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text in bytes, and `row`: a digest of both, by which a decision finds its document again; then the columns to keep."""
    own = common.pick(docs, "doc_id", "text", *keep)
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"\0"), common.as_bytes(F.col("text")))))
    return own.select("doc_id", common.as_bytes(F.col("text")).alias("text"), row.alias("row"), *keep)


class LineIndex:
    """Line counts of a changing set of documents. `shards`: filters at least, one for `SHARD_KEYS` frequent keys or fewer; `salts`: tasks that
    share a shard's or a key's lines, so that one very common line is spread."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, shards: int = SHARDS, salts: int = 16, broadcast_keys: int = BROADCAST_KEYS) -> None:
        self.spark, self.min_docs, self.shards, self.salts, self.broadcast_keys = spark, min_docs, shards, salts, broadcast_keys
        self.path = path or f"{common.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.version, self.frequent = 0, 0

    def _at(self, name: str, version: int) -> str:
        return f"{self.path}/v{version}/{name}"

    def counts(self) -> DataFrame:
        """key, docs: the exact reference counts."""
        if not self.version:
            return self.spark.createDataFrame([], "key binary, docs long, was long")
        return self.spark.read.parquet(self._at("counts", self.version)).where("docs > 0")

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, crowded boolean, body binary")
        return self.spark.read.parquet(self._at("filters", self.version))

    def keys(self) -> DataFrame:
        """The exact keys at or over the threshold."""
        return self.counts().where(F.col("docs") >= self.min_docs).select("key")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Undoes an insertion of the same documents."""
        return self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        def keys(batch: dict) -> dict:
            found: Counter[bytes] = Counter()
            for text in batch["text"]:
                found.update({digest(k) for x in text.as_py().split(b"\n") if (k := line_key(x))})
            return {"key": list(found), "docs": [sign * n for n in found.values()]}

        delta = common.per_batch(common.pick(docs, "text").select(common.as_bytes(F.col("text")).alias("text")), keys, "key binary, docs long")
        merged = self.counts().select("key", "docs", F.col("docs").alias("was")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        merged = merged.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("was").alias("was"))
        merged.write.mode("overwrite").parquet(self._at("counts", self.version + 1))
        counts = self.spark.read.parquet(self._at("counts", self.version + 1))
        over, before = F.col("docs") >= self.min_docs, F.col("was") >= self.min_docs
        self.frequent = counts.where(over).count()
        shards = self.shards
        while shards * SHARD_KEYS < self.frequent:
            shards *= 2
        old = self.filters() if shards == self.shards else self.filters().limit(0)
        self.shards = shards
        counts = counts.withColumn("shard", shard_of("key", shards))
        # Shards with a filter that has room take the keys that crossed; the others are built of all their keys.
        room = old.where("not crowded").select("shard").withColumn("room", F.lit(True))  # one row for each shard
        counts = counts.where(over | before).join(F.broadcast(room), "shard", "left")
        moved = counts.where(F.col("room") & (over != before)).select("shard", F.when(over, 2).otherwise(1).alias("kind"), F.col("key").alias("body"))
        whole = counts.where(F.col("room").isNull() & over).select("shard", F.lit(3).alias("kind"), F.col("key").alias("body"))
        kept = old.where("not crowded").select("shard", F.lit(0).alias("kind"), "body")
        self._maintained(kept.unionByName(moved).unionByName(whole)).write.mode("overwrite").parquet(self._at("filters", self.version + 1))
        self.version += 1
        return self

    @staticmethod
    def _maintained(rows: DataFrame) -> DataFrame:
        """The shards' filters from rows in order: an old filter (0), keys that leave (1) and come (2), or all keys (3)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                made = own
                if keys:
                    made = Cuckoo(2 * len(keys))
                    for k in keys:
                        made.add(k)
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.crowded]), pa.array([made.body()], pa.binary())], ["shard", "crowded", "body"])

            shard, own, keys = None, Cuckoo(), []
            for batch in batches:
                for at, kind, body in zip(*(batch[x].to_pylist() for x in ("shard", "kind", "body")), strict=True):
                    if at != shard:
                        if shard is not None:
                            yield out()
                        shard, own, keys = at, Cuckoo(), []
                    if kind == 0:
                        own = Cuckoo(body=body)
                    elif kind == 1:
                        own.remove(body)
                    elif kind == 2:
                        own.add(body)
                    else:
                        keys.append(body)
            if shard is not None:
                yield out()

        return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "shard int, crowded boolean, body binary")

    def hits(self, docs: DataFrame) -> DataFrame:
        """row, line: each line of the documents whose key is at or over the threshold, by way of the shards."""
        def lines(batch: dict) -> dict:
            rows, at, keys = [], [], []
            for row, text in zip(batch["row"], batch["text"], strict=True):
                row = row.as_py()
                for i, x in enumerate(text.as_py().split(b"\n")):
                    if k := line_key(x):
                        rows.append(row)
                        at.append(i)
                        keys.append(digest(k))
            return {"key": keys, "row": rows, "line": at}

        salts, salt = self.salts, F.pmod(F.xxhash64("row"), F.lit(self.salts)).cast("int")
        own = common.per_batch(docs.select("row", "text"), lines, "key binary, row binary, line int")
        own = own.select(shard_of("key", self.shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("kind"), F.col("key").alias("body"), "row", "line")
        each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        filters = self.filters().select("shard", each, F.lit(0).alias("kind"), "body", F.lit(None).cast("binary").alias("row"), F.lit(None).cast("int").alias("line"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, own = None, None
            for batch in batches:
                units = np.asarray(batch["shard"]).astype(np.int64) * salts + np.asarray(batch["salt"])
                kinds, cuts = np.asarray(batch["kind"]), np.flatnonzero(np.diff(units, prepend=-1))
                for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(units)], strict=True):
                    if units[start] != unit:
                        unit, own = units[start], None
                    if kinds[start] == 0:
                        own = Cuckoo(body=batch["body"][start].as_py())
                        start += 1
                    if own and start < end:
                        maybe = pa.array(start + np.flatnonzero(own.has(batch["body"].slice(start, end - start).to_pylist())))
                        yield pa.RecordBatch.from_arrays([batch[c].take(maybe) for c in ("body", "salt", "row", "line")], ["key", "salt", "row", "line"])

        maybe = own.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        maybe = maybe.mapInArrow(probe, "key binary, salt int, row binary, line int")
        return maybe.join(self.keys().select("key", each), ["key", "salt"]).select("row", "line")

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of every document, and the text columns named in `keep`."""
        schema = "doc_id long, n_lines long, n_dropped long, kept_text string" + "".join(f", {k} string" for k in keep)
        if self.frequent > self.broadcast_keys:
            own = _documents(docs, keep)
            drops = self.hits(own).groupBy("row").agg(F.collect_set("line").alias("drop"))
            return common.per_batch(own.join(drops, "row", "left").select("doc_id", "text", "drop", *keep), lambda batch: _kept(batch, [x.as_py() or () for x in batch["drop"]], keep), schema)
        # At most broadcast_keys keys of 16 bytes, and filters of two to six bytes for each.
        known = sorted(bytes(x.key) for x in self.keys().collect())
        shared = self.spark.sparkContext.broadcast((known, {x.shard: bytes(x.body) for x in self.filters().collect()}))
        shards = self.shards

        def setup() -> tuple[set[bytes], dict[int, Cuckoo]]:
            keys, bodies = shared.value
            return set(keys), {k: Cuckoo(body=x) for k, x in bodies.items()}

        def step(batch: dict) -> dict:
            exact, filters = batch[""]
            at, keys, drops = [], [], [[] for _ in batch["text"]]
            for doc, text in enumerate(batch["text"]):
                for i, x in enumerate(text.as_py().split(b"\n")):
                    if k := line_key(x):
                        at.append((doc, i))
                        keys.append(digest(k))
            if keys and filters:
                of = shards_of(keys, shards)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shards + 1))
                for s, own in filters.items():
                    mine = order[cuts[s] : cuts[s + 1]].tolist()
                    if mine:
                        for j in np.flatnonzero(own.has([keys[i] for i in mine])).tolist():
                            if keys[mine[j]] in exact:
                                doc, i = at[mine[j]]
                                drops[doc].append(i)
            return _kept(batch, drops, keep)

        own = common.pick(docs, "doc_id", "text", *keep).select("doc_id", common.as_bytes(F.col("text")).alias("text"), *keep)
        return common.per_batch(own, step, schema, setup)


def _kept(batch: dict, drops: list, keep: tuple[str, ...]) -> dict:
    """A batch's documents without the lines to drop."""
    n, out, gone = [], [], []
    for text, drop in zip(batch["text"], drops, strict=True):
        parts = text.as_py().split(b"\n")
        n.append(len(parts))
        for i in drop:
            parts[i] = None
        gone.append(len(drop))
        out.append(b"\n".join(x for x in parts if x is not None))
    return {"doc_id": batch["doc_id"], "n_lines": n, "n_dropped": gone, "kept_text": pa.array(out, pa.binary()).cast(pa.string())} | {k: batch[k] for k in keep}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = LineIndex(spark, min_docs=10).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
keyed AS (SELECT r, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, i, line, k IN (SELECT k FROM hot) AS dropped FROM keyed)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked JOIN docs d USING (r) GROUP BY r, d.doc_id
"""
