"""Near copies by the Jaccard similarity of their sets of word shingles, exactly: no pair at or over the least similarity is missed.

SimHash fingerprints of the same shingles come first: those that differ in at most 4 bits are found by the byte-position index with count
filtering of `simhash`, and pairs of their texts that the whole sets confirm are groups. A fingerprint misses pairs at 0.8, so the rest, pairs of
texts that this leaves apart, comes from an index of the shingles themselves with prefix filtering. With all shingles in
one order, two sets of that similarity share one of their first n - ceil(0.8 n) + 1, and by the first that they share, sizes and places
bound how many they can share. The order is by counts in buckets of hashes, rare ones first, so that common passages seldom are posted;
any order gives the same result. Candidates are verified by their whole sets, of which only those are made and joined whose parities (a bit or two
a shingle) leave the pair possible: where bits differ, the sets do, so that no pair at or over the least similarity is ruled out.

Lists beyond `short` texts are first linked to a few texts of each size, those with the fewest shingles of their own; only pairs that this leaves apart
are then compared.
Texts of equal words are one node. Texts of fewer words than a shingle have one of all their words, blank ones are equal to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common, simhash
from corvane.llm.components import CHUNK, components

WORDS, LEAST, SHORT, ROWS = 5, (4, 5), 8, 2000
BUCKETS, SLICES, PIVOTS = 1 << 20, 64, 8
POST = "key long, node long, n int, pos int"


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), dtype=np.uint64))


def node_of(text: bytes) -> int:
    return int.from_bytes(hashlib.md5(b" ".join(text.lower().split())).digest()[:8], "little", signed=True)


def parities(own: np.ndarray) -> bytes:
    """A bit for each bucket of hashes, as many as a power of two from the set's size on: whether it holds an odd number of the set's shingles."""
    size = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def unshared(x: bytes, y: bytes) -> int:
    """A number of shingles that two sets of these parities don't share at least: each changes one bit, shared ones none."""
    a, b = (np.frombuffer(z, "<u8") for z in (x, y))
    while len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def alike(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that share `both` have the least similarity."""
    return both * (LEAST[0] + LEAST[1]) >= LEAST[0] * (n + m)


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the texts fall into each bucket of hashes."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, "<u4")
        for batch in batches:
            for x in batch["text"]:
                np.add.at(n, (shingles(x.as_py(), words) % np.uint64(BUCKETS)).astype(np.int64), 1)
        if n.any():
            yield packed({i: x for i, x in enumerate(n.reshape(SLICES, -1))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch["slice"].to_pylist(), batch["body"].to_pylist(), strict=True):
                n[i] = n.get(i, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<u4")
        if n:
            yield packed(n)

    def packed(n: dict[int, np.ndarray]) -> pa.RecordBatch:
        bodies = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in n.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(bodies, pa.binary())], ["slice", "body"])

    out = np.zeros((SLICES, BUCKETS // SLICES), "<u4")
    for r in texts.mapInArrow(own, "slice int, body binary").repartition("slice").mapInArrow(summed, "slice int, body binary").collect():
        out[r.slice] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.body)), "<u4")
    return out.ravel()


def _posted(texts: DataFrame, words: int) -> DataFrame:
    """key, node, n, pos: each set under the first of its shingles, with its size and the shingle's place."""
    counts = texts.sparkSession.sparkContext.broadcast(_counts(texts, words))

    def step(batch: dict) -> dict | None:
        found = {}
        for x in batch["text"]:
            text = x.as_py()
            if (node := node_of(text)) not in found:
                own = shingles(text, words)
                first = len(own) - -(-LEAST[0] * len(own) // LEAST[1]) + 1 if len(own) else 0
                found[node] = own[np.argsort(counts.value[(own % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")][:first], len(own)
        sizes = [len(x) for x, _ in found.values()]
        if not sum(sizes):
            return None
        pos = np.concatenate([np.arange(x) for x in sizes])
        return {"key": pa.array(np.concatenate([x for x, _ in found.values()]).view(np.int64)), "node": pa.array(np.repeat(np.array(list(found), np.int64), sizes)), "n": pa.array(np.repeat([n for _, n in found.values()], sizes)), "pos": pa.array(pos)}

    return common.per_batch(texts, step, POST, rows=ROWS)


def _pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots of a list in order of size that sizes and places don't rule out."""
    end = np.searchsorted(n * LEAST[0], n * LEAST[1], side="right")
    for i in range(len(node) - 1):
        to = np.arange(i + 1, end[i])
        both = np.minimum(n[i] - pos[i], n[to] - pos[to])
        ok = alike(both, n[i], n[to]) & (root[to] != root[i])
        if ok.any():
            yield np.full(int(ok.sum()), node[i]), node[to[ok]]


def _central(node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots of a list in order of size with its pivots: of each stretch of sizes in reach of its first, the texts that have the fewest rarer shingles before
    the one that they share. The text that variants were made of has none, so that these link to it, and few are left apart."""
    i, end = 0, np.searchsorted(n * LEAST[0], n * LEAST[1], side="right")
    while i < len(node):
        for p in (i + np.argsort(pos[i : end[i]], kind="stable")[:PIVOTS]).tolist():
            ok = alike(np.minimum(n[p] - pos[p], n - pos), n[p], n) & (root != root[p])
            if ok.any():
                yield np.full(int(ok.sum()), node[p]), node[ok]
        i = max(int(end[i]), i + 1)


def _met(posts: DataFrame, short: int, rooted: bool) -> DataFrame:
    """a, b, n, pos, key, over: candidate pairs of different roots (over = 0); of lists beyond `short`, pairs with pivots and their rows (over = 1: node in a).
    With `rooted`, all pairs of different roots of any list."""
    columns = ["key", "node", "n", "pos", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * len(columns)
        for batch in batches:
            held = [np.concatenate([x, np.asarray(batch[c]).astype(np.int64)]) for x, c in zip(held, columns, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from of([x[:whole] for x in held])
            held = [x[whole:] for x in held]
        yield from of(held)

    def of(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(rows[0]):
            return
        new = np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])  # copies of a text stand side by side
        rows = [x[new] for x in rows]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(rows[0]) != 0]))
        ends = np.append(cuts[1:], len(rows[0]))
        found, size = [], 0
        for s, e in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist(), strict=True):
            key, node, n, pos, root = (x[s:e] for x in rows)
            if (root == root[0]).all():
                continue
            large = not rooted and e - s > short
            for pair in _central(node, n, pos, root) if large else _pairs(node, n, pos, root):
                found.append(pair)
                size += len(pair[0])
                if size > 1_000_000:
                    yield out(found)
                    found, size = [], 0
            if large:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, node, n, pos, np.ones(e - s, np.int64))], ["key", "a", "b", "n", "pos", "over"])
        if found:
            yield out(found)

    def out(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in found]) for i in range(2))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        zero = np.zeros(len(pairs), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (zero, pairs[:, 0].copy(), pairs[:, 1].copy(), zero, zero, zero)], ["key", "a", "b", "n", "pos", "over"])

    return posts.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "key long, a long, b long, n long, pos long, over long")


def _sets(met: DataFrame, ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, body: the whole sets of the nodes of rows (a, b), by a text of each."""
    def step(batch: dict) -> dict:
        return {"node": batch["node"], "body": pa.array([shingles(x.as_py(), words).tobytes() for x in batch["text"]], pa.binary())}

    met = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = common.bounded(ids.join(met, "node").groupBy("node").agg(F.min("digest").alias("digest")))
    texts = docs.withColumn("digest", common.digest_of(F.col("text"))).join(one, "digest").select("digest", "node", common.as_bytes(F.col("text")).alias("text"))
    return common.cut(common.per_batch(texts.dropDuplicates(["digest"]).select("node", "text"), step, "node long, body binary", rows=ROWS))


def _possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """a, b of the pairs that sizes and parities, of rows (node, n, odd), don't rule out."""
    def step(batch: dict) -> dict:
        n, m = (np.asarray(batch[c]).astype(np.int64) for c in ("n", "m"))
        apart = np.array([unshared(x.as_py(), y.as_py()) for x, y in zip(batch["x"], batch["y"], strict=True)], np.int64)
        ok = pa.array(alike((n + m - apart) // 2, n, m))
        return {"a": batch["a"].filter(ok), "b": batch["b"].filter(ok)}

    pairs = pairs.select("a", "b").distinct()
    x, y = (prints.select(F.col("node").alias(c), F.col("n").alias(n), F.col("odd").alias(odd)) for c, n, odd in (("a", "n", "x"), ("b", "m", "y")))
    return common.cut(common.per_batch(pairs.join(x, "a").join(y, "b"), step, "a long, b long"))


def _verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """a, b of the pairs whose whole sets, of rows (node, body), have the least similarity."""
    def step(batch: dict) -> dict:
        sides = [[np.frombuffer(x.as_py(), np.uint64) for x in batch[c]] for c in ("x", "y")]
        n, m = (np.array([len(x) for x in side], np.int64) for side in sides)
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
        ok = pa.array(alike(both, n, m))
        return {"a": batch["a"].filter(ok), "b": batch["b"].filter(ok)}

    pairs = pairs.select("a", "b").distinct()
    x, y = own.select(F.col("node").alias("a"), F.col("body").alias("x")), own.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return common.cut(common.per_batch(pairs.join(x, "a").join(y, "b"), step, "a long, b long", rows=ROWS))


def _confirmed(pairs: DataFrame, prints: DataFrame, ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """a, b of the pairs that have the least similarity; whole sets are made for those alone that parities leave."""
    pairs = _possible(pairs, prints)
    return _verified(pairs, _sets(pairs, ids, docs, words))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, digest (which tells the texts of an id apart), node."""
    def step(batch: dict) -> dict:
        texts = batch["text"].to_pylist()
        return {"doc_id": batch["doc_id"], "digest": pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), "node": [node_of(x) for x in texts]}

    own = docs.select(F.col("doc_id").cast("long"), common.as_bytes(F.col("text")).alias("text"))
    return common.per_batch(own, step, "doc_id long, digest binary, node long")


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """node, fp, n, odd: each different text's fingerprint, and its set's size and parities."""
    def step(batch: dict) -> dict:
        hashes = {node_of(x): simhash.shingle_hashes(x, words) for x in batch["text"].to_pylist()}
        sets = [np.unique(np.array(x, dtype=np.uint64)) for x in hashes.values()]
        fp = np.array([simhash.majority(x) for x in hashes.values()], np.uint64).view(np.int64)
        return {"node": list(hashes), "fp": fp, "n": [len(x) for x in sets], "odd": pa.array([parities(x) for x in sets], pa.binary())}

    texts = docs.select(common.as_bytes(F.col("text")).alias("text"))
    return common.cut(common.per_batch(texts, step, "node long, fp long, n int, odd binary", rows=ROWS).distinct())


def fingerprinted(docs: DataFrame, ids: DataFrame, words: int = WORDS, prints: DataFrame | None = None) -> DataFrame:
    """a, b: links that join the texts (nodes of ids) whose fingerprints differ in at most 4 bits, as far as their whole sets have the least similarity."""
    prints = (_prints(docs, words) if prints is None else prints).select("node", "fp")
    first = common.cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = common.keyed(prints, first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    near = simhash.links(first.select("fp")).distinct().join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    pairs = common.cut(same.unionByName(near))
    return _verified(pairs, _sets(pairs, ids, docs, words))


def _rooted(rows: DataFrame, root: DataFrame) -> DataFrame:
    return rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def grouped(docs: DataFrame, words: int = WORDS, short: int = SHORT) -> DataFrame:
    """doc_id, digest, root: the group of each row, joined by pairs of at least the least similarity."""
    docs = common.pick(docs, "doc_id", "text")
    ids = common.cut(nodes(docs))
    prints = _prints(docs, words)
    links = fingerprinted(docs, ids, words, prints)
    root = common.bounded(components(links, whole=CHUNK))
    met = common.cut(_met(_rooted(_posted(docs.select(common.as_bytes(F.col("text")).alias("text")), words), root), short, False))
    links = links.unionByName(_confirmed(met.where("over = 0"), prints, ids, docs, words))
    root = common.cut(components(links, whole=CHUNK))
    over = _rooted(met.where("over = 1").select("key", F.col("a").alias("node"), "n", "pos"), root)
    if not over.isEmpty():
        rest = _confirmed(_met(over, short, True), prints, ids, docs, words)
        root = components(links.unionByName(rest), whole=CHUNK)
    return ids.join(root, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, words: int = WORDS, short: int = SHORT) -> DataFrame:
    """doc_id, digest of the one document that stays of each group: that with the least doc_id, then the least digest, an id before a null;
    and copies: how many rows have both."""
    rows = grouped(docs, words, short).groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "copies")).alias("first")
    return rows.groupBy("root").agg(first).select("first.doc_id", "first.digest", "first.copies")
