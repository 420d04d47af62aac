"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two that differ in at most `bits` = 4 bits share at least 8 - 4 = 4 of them, and so at least 3
of the first 7. The index posts each distinct fingerprint under its 35 sets of 3 of these bytes, not under single bytes, whose lists
would each hold one in 256 of all. A pair that meets in a list has the positional bytes that it shares tallied; pairs under the
guaranteed minimum of 4 are left out, the others are verified by their differing bits.

A list's pairs aren't written out: short lists give each link once, long ones the edges of a spanning forest. Lists beyond
`limit` fingerprints are posted again under each fourth byte that a pair of them can share, and lists that are still beyond it under
half bytes of the 4 bytes that are left, where a list has at most 65,536 fingerprints. Exact copies share a fingerprint, which is
indexed once.

Defined results: a null or blank text has fingerprint zero, linked like any other. Repeated rows are rows of their own with
equal results. Rows with a null doc_id are in components, but name none unless all their component's ids are null (then null).
Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.components import components

BYTES, BITS, LIMIT, SHORT = 8, 4, 16_384, 16
#: Sets of as many positions as a pair is sure to share of the first 7, and of all 8.
FIRST = np.array(list(combinations(range(BYTES - 1), BYTES - 1 - BITS)), dtype=np.int64)
SETS = np.array(list(combinations(range(BYTES), BYTES - BITS)), dtype=np.int64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """The XXH64 of the shingles; that of all words where they are fewer, none if there is no word."""
    parts = text.lower().split()
    if not parts:
        return []
    if len(parts) < words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [hashed(joined[i:j], 42) for i, j in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """Bits set in over half of these 64-bit hashes; zero if there is none."""
    if not hashes:
        return 0
    found = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 4096):
        counts += np.unpackbits(found[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half the XXH64 of the shingles; zero if there is no word."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long; and digest, which tells the texts of an id apart."""
    def step(batch: dict) -> dict:
        found = np.array([fingerprint(x.as_py(), words) for x in batch["text"]], dtype=np.uint64)
        return {"doc_id": batch["doc_id"], "fp": found.view(np.int64), "digest": pa.array([hashlib.md5(x.as_py()).digest() for x in batch["text"]], pa.binary())}

    own = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), common.as_bytes(F.col("text")).alias("text"))
    return common.per_batch(own, step, "doc_id long, fp long, digest binary")


def _keys(fp: np.ndarray, sets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The lists of fingerprints, a row each: the number of the set of positions (`of`, a row each), and the bytes at them."""
    parts = fp.view(np.uint8).reshape(-1, BYTES).astype(np.int64)
    keys = of << (8 * sets.shape[1])
    for i in range(sets.shape[1]):
        keys = keys | (np.take_along_axis(parts, sets[of, i], axis=1) << (8 * i))
    return keys


def _posted(rows: DataFrame, column: str, keys, width: int) -> DataFrame:
    """key, fp: each row's fingerprint under the lists that keys(batch, fingerprints) gives, `width` a row."""
    def step(batch: dict) -> dict:
        fp = np.asarray(batch[column])
        return {"key": pa.array(keys(batch, fp).ravel()), "fp": pa.array(np.repeat(fp, width))}

    return common.per_batch(rows, step, "key long, fp long")


def _postings(fps: DataFrame) -> DataFrame:
    """key, fp: each fingerprint under its 35 sets of 3 of the first 7 positional bytes."""
    every = np.arange(len(FIRST))[None, :]
    return _posted(fps, "fp", lambda _, fp: _keys(fp, FIRST, np.repeat(every, len(fp), axis=0)), len(FIRST))


def _deeper(rows: DataFrame) -> DataFrame:
    """key, fp of long lists (a, b) again under each set of 4 positional bytes that has the list's three."""
    number = {tuple(x): i for i, x in enumerate(SETS.tolist())}
    wider = np.array([[number[tuple(sorted([*x, p]))] for p in range(BYTES) if p not in x] for x in FIRST.tolist()])
    return _posted(rows, "b", lambda batch, fp: _keys(fp, SETS, wider[np.asarray(batch["a"]) >> (8 * FIRST.shape[1])]), wider.shape[1])


def _finer(rows: DataFrame) -> DataFrame:
    """key, fp of long lists again under 70 sets of 4 half bytes of the 4 bytes that the list leaves open."""
    open_bytes = np.array([[j for j in range(BYTES) if j not in x] for x in SETS.tolist()], dtype=np.int64)

    def step(batch: dict) -> dict:
        key, fp = np.asarray(batch["a"]), np.asarray(batch["b"])
        left = np.take_along_axis(fp.view(np.uint8).reshape(-1, BYTES).astype(np.int64), open_bytes[key >> 32], axis=1)
        halves = np.stack([left & 15, left >> 4], axis=2).reshape(len(fp), 8)
        subs = np.arange(len(SETS), dtype=np.int64)[None, :] << 16
        for i in range(SETS.shape[1]):
            subs = subs | (halves[:, SETS[:, i]] << (4 * i))
        return {"list": pa.array(np.repeat(key, len(SETS))), "key": pa.array(subs.ravel()), "fp": pa.array(np.repeat(fp, len(SETS)))}

    return common.per_batch(rows, step, "list long, key long, fp long")


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs share the guaranteed number of positional bytes, and of these whether they differ in few enough bits."""
    differing = a ^ b
    out = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - BITS
    out[out] = np.bitwise_count(differing[out].view(np.uint64)) <= BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join what is linked in a list of distinct fingerprints; a fingerprint is compared with those not yet reached."""
    out, todo = [], fps
    while len(todo) > 1:
        reached, todo = [todo[0]], todo[1:]
        while reached and len(todo):
            near = close(todo, x := reached.pop())
            if near.any():
                found = todo[near]
                out.append((np.full(len(found), x), found))
                reached += found.tolist()
                todo = todo[~near]
    return out


def _links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole lists, sorted by key and fingerprint."""
    out = []
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    sizes = np.diff(cuts, append=len(keys))
    of = np.repeat(sizes, sizes)
    small = np.flatnonzero((of > 1) & (of <= SHORT))
    if len(small):
        k, f = keys[small], fps[small]
        for d in range(1, SHORT):
            at = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else []
            if not len(at):
                break
            linked = at[close(f[at], f[at + d])]
            out.append((f[linked], f[linked + d]))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out += forest(fps[cuts[i] : cuts[i] + sizes[i]])
    return out


def _matched(rows: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    """a, b, over: links (over = 0), and the rows (key, fp) of lists beyond the limit (over = 1). Holds one list of up to `limit` at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, over: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), over, np.int32))], ["a", "b", "over"])

        held: list[np.ndarray] = [np.empty(0, np.int64)] * (len(by) + 1)
        passed = None
        for batch in batches:
            held = [np.concatenate([x, np.asarray(batch[c])]) for x, c in zip(held, [*by, "fp"], strict=True)]
            if passed is not None and limit:
                same = int(np.searchsorted(held[0] != passed, True))
                if same:
                    yield out(held[0][:same], held[-1][:same], 1)
                    held = [x[same:] for x in held]
                if not len(held[0]):
                    continue
                passed = None
            ids = np.zeros(len(held[0]), np.int64)
            for x in held[:-1]:
                ids[1:] += x[1:] != x[:-1]
            ids = np.cumsum(ids)
            whole = int(np.searchsorted(ids, ids[-1]))
            yield from finish(ids[:whole], held[-1][:whole], held[0][:whole])
            held = [x[whole:] for x in held]
            if limit and len(held[0]) > limit:
                yield out(held[0], held[-1], 1)
                passed, held = held[0][0], [x[:0] for x in held]
        if len(held[0]):
            yield from finish(np.zeros(len(held[0]), np.int64), held[-1], held[0])

    def finish(ids: np.ndarray, fps: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1 and len(found := _links(ids, fps)):
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.zeros(len(pairs), np.int32))], ["a", "b", "over"])

    return rows.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a long, b long, over int")


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """a, b: edges between distinct fingerprints that join all that differ in at most 4 bits."""
    first = common.cut(_matched(_postings(fps), ["key"], limit))
    found, over = first.where("over = 0").select("a", "b"), first.where("over = 1").select("a", "b")
    if not over.isEmpty():
        second = common.cut(_matched(_deeper(over), ["key"], limit))
        found, over = found.unionByName(second.where("over = 0").select("a", "b")), second.where("over = 1").select("a", "b")
        if not over.isEmpty():
            found = found.unionByName(_matched(_finer(over), ["list", "key"], None).select("a", "b"))
    return found


def groups(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """fp, root, component_id: the group that each distinct fingerprint is in, and its least doc_id, for rows (doc_id, fp)."""
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(distinct.select("fp"), limit)).withColumnRenamed("node", "fp")
    member = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = common.cut(member)
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return common.keyed(member, ids, "root").select("fp", "root", "component_id")


def components_of(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, component_id for rows (doc_id, fp)."""
    return common.keyed(prints, common.cut(groups(prints, limit)), "fp").select("doc_id", "fp", "component_id")


def representatives(prints: DataFrame) -> DataFrame:
    """doc_id, digest of the one row that stays of each group: that with the least doc_id, then the least digest; an id goes before a null."""
    own = prints.join(groups(prints).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    return own.groupBy("root").agg(first).select("first.doc_id", "first.digest")


def hexadecimal(column: str) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = common.cut(fingerprints(common.table(spark, sf_dir, "documents"), words=4))
    out = components_of(prints)
    return out.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
