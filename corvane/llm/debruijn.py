"""Removal of passages that an earlier document has, by compaction of the de Bruijn graph of repeated word windows.

An edge is a window of `WORDS` words, from the node of its first twelve to that of its last twelve. An edge is repeated if documents
of two ids hold it; its source is the first place of the least id. Two edges that follow each other are linked if the node between
them doesn't branch: wherever the one is, the other follows, and wherever the other is, the one goes before (an end of a text is a
branch). So all edges of a nonbranching path stand in the same documents, each of which holds the whole path, and have one source text,
at coordinates that follow each other; a path is extended over these only. A document loses the words of each path whose source
has a lesser id.

1. Each window has an anchor, the least hash of its five-word grams. Tasks send the distinct anchors of their texts; those met once
   in the corpus are left out, and with them the windows that they stand for, which cannot be repeated.
2. Tasks compact the graph of their own texts, and send its paths in pieces of one anchor, to the anchor's shard. There each edge meets
   all its occurrences (one for each batch of texts, so that a passage in every document is no hot key), its ids and neighbours are
   settled, and the pieces are cut where a node branches.
3. Spark joins each piece with the one that follows it at its source, and a window over the source text's coordinates sums linked
   pieces to paths; a join with the pieces of each part of the input tells the part its paths. Texts never move.

A window is named by 96 bits of two hashes of its words. Defined results: a null text has no words. A null doc_id counts as greater
than all ids. Rows with equal ids don't take from each other, repeated rows have equal results. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.anchors import sliding
from corvane.llm.repeats import _packed, _unpacked

WORDS, GRAM = 13, 5
REACH = WORDS - GRAM + 1  # grams in a window
CHUNK, ROWS, PART_BITS = 1 << 20, 1500, 12
SHARD_BYTES = 64 << 20
LAST = (1 << 63) - 1


class Hash:
    """Hashes of any stretch of bytes from sums over its beginning and end: powers of an odd number, and of its inverse, modulo 2^64."""

    def __init__(self, seed: int) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.bytes = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd = int(draw.integers(1 << 60, 1 << 61)) * 8 + 5
        self.powers = self.inverses = np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            size = max(CHUNK * 5 // 4, len(data) + 1)
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (np.uint64(self.odd), np.uint64(pow(self.odd, -1, 1 << 64))))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes[data] * self.powers[: len(data)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (sums[end] - sums[start]) * self.inverses[start]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (out ^ (out >> np.uint64(29))) | np.uint64(1)


KEY, CHECK = Hash(11), Hash(12)


class Windows:
    """Windows of several texts' words: `at` the number of each one's first word among all words, `doc` its text, `anchor`, `key`, `check`."""

    def __init__(self, texts: list[bytes], check: bool = True) -> None:
        self.rows = [x.split() for x in texts]
        n = np.fromiter(map(len, self.rows), np.int64, len(self.rows))
        self.first = np.cumsum(n) - n
        windows = np.maximum(n - WORDS + 1, 0)
        ends = np.cumsum(windows)
        self.doc = np.repeat(np.arange(len(n)), windows)
        total = int(ends[-1]) if len(ends) else 0
        self.place = np.arange(total) - np.repeat(ends - windows, windows)  # in its text
        self.at = self.place + self.first[self.doc]
        self.anchor = self.key = self.check = np.empty(0, np.uint64)
        if not total:
            return
        data = np.frombuffer(b" ".join([b" ".join(x) for x in self.rows if x]) + b" ", np.uint8)
        end = np.flatnonzero(data == 32)
        start = np.concatenate([[0], end[:-1] + 1])
        sums = KEY.sums(data)
        grams = KEY.of(sums, start[: len(start) - GRAM + 1], end[GRAM - 1 :])
        self.anchor = sliding(grams, REACH, True)[self.at]
        if check:
            start, end = start[self.at], end[self.at + WORDS - 1]
            self.key = KEY.of(sums, start, end)
            self.check = (CHECK.of(CHECK.sums(data), start, end) >> np.uint64(32)).astype(np.uint32)


def parts_of(docs: DataFrame) -> DataFrame:
    """part (of 4,096 rows of a file), rid (the row), did, doc_id, text in bytes, of a plain read of Parquet files."""
    at, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.abs(F.xxhash64(at, F.shiftright(row, PART_BITS))).alias("part"), F.xxhash64(at, row).alias("rid"), F.coalesce(doc_id, F.lit(LAST)).alias("did"), doc_id.alias("doc_id"), common.as_bytes(F.col("text")).alias("text"))


def _chunks(batch: dict, check: bool = True) -> Iterator[tuple[int, int, int, Windows]]:
    """(part, first row, row after the last, windows) of stretches of rows of one part, of some `CHUNK` bytes each."""
    part, size = np.asarray(batch["part"]), np.cumsum(np.asarray(pa.compute.binary_length(batch["text"])).astype(np.int64))
    start = 0
    while start < len(part):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + CHUNK, side="right")))
        if (other := np.flatnonzero(part[start:end] != part[start])).size:
            end = start + int(other[0])
        yield int(part[start]), start, end, Windows(batch["text"].slice(start, end - start).to_pylist(), check)
        start = end


def _dealt(values: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its values, in order."""
    shard = ((values >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _anchors(rows: DataFrame, shards: int) -> DataFrame:
    """shard, part, body: the distinct anchors of the texts of a part that meet in a batch, and whether several of them have it."""
    def step(batch: dict) -> dict:
        met: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part, start, _, own in _chunks(batch, check=False):
            if len(own.doc):
                new = np.flatnonzero((np.diff(own.anchor, prepend=np.uint64(0)) != 0) | (np.diff(own.doc, prepend=-1) != 0))
                met.setdefault(part, []).append((own.anchor[new], own.doc[new] + start))
        out: dict[str, list] = {"shard": [], "part": [], "body": []}
        for part, found in met.items():
            anchor, doc = (np.concatenate([x[i] for x in found]) for i in range(2))
            order = np.argsort(anchor, kind="stable")
            cuts = np.flatnonzero(np.diff(anchor[order], prepend=np.uint64(0)) != 0)
            anchor, several = anchor[order][cuts], (np.minimum.reduceat(doc[order], cuts) != np.maximum.reduceat(doc[order], cuts)).astype(np.uint8)
            for shard, at in _dealt(anchor, shards):
                for k, v in zip(out, (shard, part, _packed([anchor[at], several[at]])), strict=True):
                    out[k].append(v)
        return out

    return common.per_batch(rows.select("part", "text"), step, "shard int, part long, body binary")


def _by_shard(df: DataFrame, shards: int, of, schema: str) -> DataFrame:
    """`of`(parts, bodies) for each shard."""
    target = common._arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, bodies = None, [], []
        for batch in batches:
            for at, part, body in zip(batch["shard"].to_pylist(), batch["part"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if at != shard and bodies:
                    yield from common.batches_of(of(parts, bodies), target)
                    parts, bodies = [], []
                shard = at
                parts.append(part)
                bodies.append(body)
        if bodies:
            yield from common.batches_of(of(parts, bodies), target)
        parts = bodies = None
        common.give_back()

    return df.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _met(parts: list[int], bodies: list[bytes]) -> dict:
    """Anchors that several texts have, for each part that has them."""
    found = [_unpacked(x, ["<u8", "u1"]) for x in bodies]
    anchor, several = (np.concatenate([x[i] for x in found]) for i in range(2))
    part = np.repeat(np.array(parts, np.int64), [len(x[0]) for x in found])
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.diff(anchor[order], prepend=np.uint64(0)) != 0)
    n = np.diff(np.append(cuts, len(order)))
    told = order[np.repeat((n > 1) | (np.maximum.reduceat(several[order], cuts) > 0), n)]
    return {"part": part[told], "anchor": anchor[told].view(np.int64)}


def _only(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The one value, or zero where there are several."""
    return np.where(low == high, low, np.uint64(0))


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row by these keys, the first one first; equal rows have one rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for x in keys:
        new[1:] |= x[order][1:] != x[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def compacted(own: Windows, which: np.ndarray, did: np.ndarray, rid: np.ndarray) -> dict[str, np.ndarray] | None:
    """Nonbranching paths of these windows' graph, in pieces of one anchor: n, prev, next (0 where it branches), lo, hi, rid, pos, anchor by piece; key, check by edge."""
    if not len(which):
        return None
    key, doc, at = own.key[which], own.doc[which], own.at[which]
    inner = own.place[which] > 0
    prev = np.where(inner, own.key[which - 1], np.uint64(0))
    last = np.append(own.doc[1:] != own.doc[:-1], True)[which]
    after = np.where(last, np.uint64(0), own.key[np.minimum(which + 1, len(own.key) - 1)])
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=np.uint64(0)) != 0)
    edge = np.empty(len(key), np.int64)
    edge[order] = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(order))))
    one_prev, one_next = (_only(np.minimum.reduceat(x[order], cuts), np.maximum.reduceat(x[order], cuts)) for x in (prev, after))
    source = np.minimum.reduceat((_ranks(did, rid)[doc] << 32 | own.place[which])[order], cuts)
    high = np.maximum.reduceat(did[doc][order], cuts)
    linked = np.zeros(len(key), bool)
    linked[1:] = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1]) & (one_next[edge[:-1]] == key[1:]) & (one_prev[edge[1:]] == key[:-1])
    heads = np.flatnonzero(~linked)
    n = np.diff(np.append(heads, len(key)))
    first = order[cuts]
    mine = np.repeat(first[edge[heads]] == heads, n)  # of the traversals of a path, that which begins first
    anchor = own.anchor[which]
    new = (~linked | np.append(True, anchor[1:] != anchor[:-1]))[mine]
    edge, key, check, anchor = edge[mine], key[mine], own.check[which][mine], anchor[mine]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(edge)))
    of = source[edge[start]]
    by_rank = np.empty(len(did), np.int64)  # some document of each rank
    by_rank[_ranks(did, rid)] = np.arange(len(did))
    doc = by_rank[of >> 32]
    return {"n": n, "prev": one_prev[edge[start]], "next": one_next[edge[start + n - 1]], "lo": did[doc], "hi": high[edge[start]], "rid": rid[doc], "pos": of & 0xFFFFFFFF, "anchor": anchor[start], "key": key, "check": check}


KINDS = {"n": "<u4", "prev": "<u8", "next": "<u8", "lo": "<i8", "hi": "<i8", "rid": "<i8", "pos": "<u4", "key": "<u8", "check": "<u4"}
PIECE = "part long, key long, check long, n long, did long, rid long, pos long, prev long, last long, next long"


def _paths(rows: DataFrame, shards: int, shared: str) -> DataFrame:
    """shard, part, body: the pieces of paths of a chunk of texts, by their anchors' shards."""
    def setup() -> common.PartTable:
        return common.PartTable(shared, ["anchor"])

    def step(batch: dict) -> dict:
        did, rid = np.asarray(batch["did"]), np.asarray(batch["rid"])
        out: dict[str, list] = {"shard": [], "part": [], "body": []}
        for part, start, end, own in _chunks(batch):
            table = batch[""].of(part)
            if table is None or not len(own.doc):
                continue
            met = np.sort(table["anchor"].to_numpy().view(np.uint64))
            which = np.flatnonzero(met[np.minimum(np.searchsorted(met, own.anchor), len(met) - 1)] == own.anchor)
            paths = compacted(own, which, did[start:end], rid[start:end])
            if paths is None:
                continue
            n = paths["n"]
            begin = np.cumsum(n) - n
            for shard, at in _dealt(paths["anchor"], shards):
                ends = np.cumsum(n[at])
                edges = np.arange(ends[-1]) + np.repeat(begin[at] - (ends - n[at]), n[at])
                out["shard"].append(shard)
                out["part"].append(part)
                out["body"].append(_packed([paths[k][edges if k in ("key", "check") else at].astype(kind) for k, kind in KINDS.items()]))
        return out

    return common.per_batch(rows.select("part", "did", "rid", "text"), step, "shard int, part long, body binary", setup, ROWS)


def _pieces(parts: list[int], bodies: list[bytes]) -> dict:
    """PIECE rows of a shard: repeated edges that are linked in the whole corpus, for each part that has them."""
    found = [_unpacked(x, list(KINDS.values())) for x in bodies]
    n, prev, after, lo, hi, rid, pos, key, check = (np.concatenate([x[i] for x in found]) for i in range(len(KINDS)))
    part = np.repeat(np.array(parts, np.int64), [len(x[0]) for x in found])
    n = n.astype(np.int64)
    begin = np.cumsum(n) - n
    piece = np.repeat(np.arange(len(n)), n)
    place = pos.astype(np.int64)[piece] + np.arange(len(key)) - begin[piece]
    before, behind = np.empty_like(key), np.empty_like(key)
    before[1:], behind[:-1] = key[:-1], key[1:]
    before[begin], behind[begin + n - 1] = prev, after
    order = np.lexsort((check, key))
    new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0))
    cuts = np.flatnonzero(new)
    edge = np.empty(len(key), np.int64)
    edge[order] = np.cumsum(new) - 1
    rank = _ranks(lo, rid)
    source = np.minimum.reduceat((rank[piece] << 32 | place)[order], cuts)
    by_rank = np.empty(int(rank.max()) + 1, np.int64)
    by_rank[rank] = np.arange(len(rank))
    repeated = lo[by_rank[source >> 32]] < np.maximum.reduceat(hi[piece][order], cuts)
    one_prev, one_next = (_only(np.minimum.reduceat(x[order], cuts), np.maximum.reduceat(x[order], cuts)) for x in (before, behind))
    linked = np.zeros(len(key), bool)
    a, b = edge[:-1], edge[1:]
    linked[1:] = (piece[1:] == piece[:-1]) & (one_next[a] == key[1:]) & (one_prev[b] == key[:-1]) & (source[b] == source[a] + 1)
    head = np.flatnonzero(~linked)
    n = np.diff(np.append(head, len(key)))
    head, n = head[repeated[edge[head]]], n[repeated[edge[head]]]
    first, last = edge[head], edge[head + n - 1]
    doc = by_rank[source[first] >> 32]
    return {
        "part": part[piece[head]], "key": key[head].view(np.int64), "check": check[head].astype(np.int64), "n": n, "did": lo[doc], "rid": rid[doc],
        "pos": source[first] & 0xFFFFFFFF, "prev": one_prev[first].view(np.int64), "last": key[head + n - 1].view(np.int64), "next": one_next[last].view(np.int64),
    }


def paths(pieces: DataFrame) -> DataFrame:
    """key, check, n, did, pos of each path: the name of its first edge, its edges, and its source. A piece goes on a path if the piece
    that ends before it at the source has it as its only follower, and it that one as its only forerunner."""
    own = pieces.drop("part").distinct()
    ahead = own.where("next <> 0").select(F.col("next").alias("key"), F.col("last").alias("prev"), "rid", (F.col("pos") + F.col("n")).alias("pos"), F.lit(True).alias("on"))
    own = own.join(ahead, ["key", "prev", "rid", "pos"], "left")
    text = Window.partitionBy("rid").orderBy("pos", "key", "check")  # a text's pieces
    own = own.withColumn("path", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(text))
    head = F.min_by(F.struct("key", "check", "did", "pos"), F.col("pos")).alias("head")
    return own.groupBy("rid", "path").agg(head, F.sum("n").alias("n")).select("head.*", "n")


OUT = "doc_id long, n_words long, n_removed long, spans array<long>, sources array<long>, kept binary"


def _kept(rows: DataFrame, told: str) -> DataFrame:
    def setup() -> common.PartTable:
        return common.PartTable(told, ["key", "check", "n", "did", "pos"])

    def step(batch: dict) -> dict:
        did = np.asarray(batch["did"])
        out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "spans", "sources", "kept")}
        for part, start, end, own in _chunks(batch):
            table, total = batch[""].of(part), sum(map(len, own.rows))
            cover, found = np.zeros(total + 1, np.int64), {}
            if table is not None and len(own.doc):
                key, check, n, source, pos = (table[x].to_numpy() for x in ("key", "check", "n", "did", "pos"))
                key = key.view(np.uint64)
                order = np.lexsort((check, key))
                key, check, n, source, pos = key[order], check[order], n[order], source[order], pos[order]
                low, high = np.searchsorted(key, own.key), np.searchsorted(key, own.key, side="right")
                for turn in range(int((high - low).max())):  # more than one turn only where names of 64 bits meet
                    at = np.flatnonzero(low + turn < high)
                    path = low[at] + turn
                    fits = (check[path] == own.check[at]) & (source[path] < did[start:end][own.doc[at]])
                    at, path = at[fits], path[fits]
                    np.add.at(cover, own.at[at], 1)
                    np.add.at(cover, own.at[at] + n[path] + WORDS - 1, -1)
                    for d, row in zip(own.doc[at].tolist(), np.stack([own.place[at], n[path] + WORDS - 1, source[path], pos[path]], axis=1).tolist(), strict=True):
                        found.setdefault(d, []).append(row)
            gone = np.cumsum(cover[:-1]) > 0
            for d, words in enumerate(own.rows):
                lost = gone[own.first[d] : own.first[d] + len(words)]
                spans = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).tolist() if d in found else []
                out["n_words"].append(len(words))
                out["n_removed"].append(int(lost.sum()))
                out["spans"].append(spans)
                out["sources"].append([x for row in sorted(found.get(d, [])) for x in row])
                out["kept"].append(b" ".join(compress(words, (~lost).tolist()) if spans else words))
        return {"doc_id": batch["doc_id"], **out}

    return common.per_batch(rows, step, OUT, setup, ROWS)


def removed(docs: DataFrame, scan: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (starts and ends of runs of removed words in turn), sources (of each path that is removed: its first word,
    its words, its source's doc_id and first word there), kept (the words left, a space between them) of every document.

    `scan`: docs is a plain read of Parquet files with no clashing names; anything else is written to the shared folder first.
    """
    spark = docs.sparkSession
    if not scan or len({x.lower() for x in docs.columns}) < len(docs.columns):
        docs = spark.read.schema("doc_id long, text string").parquet(common.stored(common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")))
    rows = parts_of(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    shared = common.stored_by_part(_by_shard(_anchors(rows, shards), shards, _met, "part long, anchor long"))
    pieces = spark.read.schema(PIECE).parquet(common.stored(_by_shard(_paths(rows, shards, shared), shards, _pieces, PIECE)))
    told = pieces.select("part", "key", "check").distinct().join(paths(pieces), ["key", "check"])
    return _kept(rows, common.stored_by_part(told))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(common.table(spark, sf_dir, "documents"), scan=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of 13 words with the first document of each; quick enough for small tables only.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
i AS (SELECT r, o, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
g AS (SELECT r, o, i, array_to_string(w[i:i + 12], ' ') AS g FROM i),
f AS (SELECT g, min(o) AS first FROM g GROUP BY g HAVING min(o) < max(o)),
m AS (SELECT r, i FROM g JOIN f USING (g) WHERE o > first),
c AS (SELECT DISTINCT r, i + unnest(range(13)) AS j FROM m),
l AS (SELECT r, list(j) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, k: NOT list_contains(gone, k)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""
